import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataquery.llm import bpe, token_counts
from strataquery.llm.token_counts import BLOCK, SegmentTree, build, edit

CODER = bpe.coder(bpe.default_vocabulary())
ALPHABET = ["<|endo", "ftext|>", "<|", " ", "  ", "\n", "a", "the", " word", "'s", "'", "1", "23", "!", "é", "\t", "<|endoftext|>", " ", "漢"]


def count(text, special=True):
    return len(CODER.encode(text)) // 4 if special else CODER.count(CODER.pieces(text))


def check(text, tree, special=True):
    assert tree.total == count(text, special)
    chars, tokens = tree.leaf_lists()
    assert sum(chars) == len(text) and sum(tokens) == tree.total
    for i in range(1, tree.width):
        assert tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1]


@settings(max_examples=300, deadline=None)
@given(st.booleans(), st.lists(st.sampled_from(ALPHABET), max_size=300), st.lists(st.tuples(st.integers(-5, 600), st.integers(-3, 80), st.lists(st.sampled_from(ALPHABET), max_size=90)), max_size=5))
def test_counts_after_any_edits_equal_a_fresh_count(special, parts, edits):
    text = "".join(parts)
    tree = build(text, CODER, special)
    check(text, tree, special)
    for start, removed, inserted in edits:
        new = "".join(inserted)
        s = min(max(start, 0), len(text))
        want = text[:s] + new + text[min(s + max(removed, 0), len(text)) :]
        text, tree, _ = edit(text, tree, start, removed, new, CODER, special)
        assert text == want
        check(text, tree, special)


def test_an_edit_in_a_long_text_touches_little():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(50_000))
    tree = build(text, CODER)
    text, tree, cost = edit(text, tree, len(text) // 2, 3, "changed", CODER)
    check(text, tree)
    assert cost < 4 * BLOCK * 10 < len(text) / 50


def test_a_text_without_boundaries_is_still_counted():
    tree = build("a" * 20_000, CODER)
    text, tree, _ = edit("a" * 20_000, tree, 10_000, 1, "b", CODER)
    check(text, tree)


def test_packing_round_trip():
    tree = SegmentTree([3, 4, 5], [1, 2, 3])
    again = SegmentTree.unpacked(tree.packed())
    assert (again.chars, again.tokens, again.leaves) == (tree.chars, tree.tokens, tree.leaves)


def test_nulls_and_empty_rows(spark):
    schema = f"doc_id long, text string, edits {token_counts.EDITS}, tree2 string"
    rows = [(1, None, None, "x"), (2, "", [], "x"), (3, "abc", [None, (None, None, None)], "x"), (None, "a b", [(0, 99, None)], "x"), (5, None, [(3, 1, "new text")], "x")]
    df = spark.createDataFrame(rows, schema)
    got = {r["text"]: r for r in token_counts.apply_edits(token_counts.with_trees(df), "edits", tree="tree").select("text", F.col("edited.text").alias("now"), token_counts.token_total(F.col("edited.tree")).alias("n")).collect()}
    assert got["abc"]["now"] == "abc" and got["a b"]["now"] == "" and got["a b"]["n"] == 0 and got[""]["n"] == 0
    assert token_counts.apply_edits(df.limit(0), "edits").count() == 0
    built = token_counts.apply_edits(df, "edits").where("doc_id = 5").select("edited.text", "edited.tokens_before").first()
    assert tuple(built) == ("new text", 0)


def test_query_equals_full_counts(spark, sf):
    from strataquery.llm.queries import op1_token_counts

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_token_counts(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        n = len(text)
        now = text
        for at, removed, new in ((n * 3 // 4, 12, ""), (n // 2, 0, " [note] "), (n // 4, 7, "###")):
            now = now[:at] + new + now[at + removed :]
        assert (r["n_tokens"], r["n_tokens_edited"], r["edited_chars"]) == (count(text), count(now), len(now))


@pytest.mark.parametrize("text", ["x <|endoftext|> y", "  ", "՘"])
def test_special_strings_are_ordinary_text(text):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.default_vocabulary())
    own.encode_special_tokens = True
    assert build(text, CODER, special=False).total == len(own.encode(text, add_special_tokens=False).ids)


def test_counts_agree_with_the_encoder(spark, sf):
    from strataquery.llm.queries import op1_token_counts, op5_bpe

    one = {r["doc_id"]: r["n_tokens"] for r in op1_token_counts(spark, sf).collect()}
    assert one == {r["doc_id"]: r["n_tokens"] for r in op5_bpe(spark, sf).collect()}
    odd = spark.createDataFrame([(1, "a<|endoftext|>b <|endoftext|>"), (2, "<|endo"), (3, None), (4, "")], "doc_id long, text string")
    edits = odd.withColumn("edits", F.expr("array(named_struct('start', 6L, 'removed', 0L, 'inserted', 'ftext|>'), named_struct('start', 1L, 'removed', 2L, 'inserted', ''))"))
    got = {r["doc_id"]: r["e"] for r in token_counts.apply_edits(edits, "edits", into="e").collect()}
    for e in got.values():
        assert SegmentTree.unpacked(e["tree"]).total == count(e["text"])
    assert got[1]["tokens_before"] == count("a<|endoftext|>b <|endoftext|>") and got[2]["text"] == "<ndoftext|>"
