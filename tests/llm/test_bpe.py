import random

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from strataquery.llm import bpe
from tests.llm.brute import token_row, tokenizer

CODER = bpe.coder(bpe.default_vocabulary())
TRICKY = [
    None, "", " ", "   ", "\n\n  a", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "don't we'll I'VE 'sup !'s", "é ü ñ ß 漢字 かな 🙂👩‍👩‍👧", "x y z　",
    "՘֋ tail", "\U0003fc3b a", "tab\tcr\r\nlf", "a" * 5000, " " * 3000 + "x", "1234567890" * 50, "\x00\x01\x1c\x1f\x85", "ﬁ ﬀ İı", "éä", "THERHAOU!! OUSHED!!", "the*** of%%% ###", "﻿bom",
]


def same(text):
    ids = CODER.encode(text or "")
    want = tokenizer().encode(text or "", add_special_tokens=False).ids
    assert list(bpe._unpacked(ids)) == want, repr(text)[:80]
    assert CODER.decode(ids) == tokenizer().decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", TRICKY)
def test_tricky_texts_match_the_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text_matches_the_library(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\t", "a", "'s", "é", "1", "!", "<|endoftext|>", "the", " ", "漢", "'"]), max_size=40))
def test_any_mix_of_classes_matches_the_library(parts):
    same("".join(parts))


def test_pieces_agree_with_the_pre_tokenizer_for_every_character():
    known = CODER._split
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        text = f"a{chr(cp)}1{chr(cp)}!{chr(cp)}"
        if not bpe._odd(text) and cp % 3 == 0:
            assert [x for x in CODER.pattern.findall(text)] == [text[a:b] for _, (a, b) in known.pre_tokenize_str(text)], hex(cp)


def test_cuts_are_where_no_token_has_both_bytes():
    rng = random.Random(4)
    neighbours = {token[i : i + 2] for token in CODER.table for i in range(len(token) - 1)}
    for _ in range(300):
        piece = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 30)))
        parts = CODER.fragments(piece)
        assert b"".join(parts) == piece
        for a, b in zip(parts, parts[1:]):
            assert a[-1:] + b[:1] not in neighbours
        for part in parts:
            assert all(part[i : i + 2] in neighbours for i in range(len(part) - 1))


def test_long_text_is_walked(monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    same("the quick brown fox <|endoftext|> jumps over it's 123 lazy dogs")


def test_caches_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    own = bpe.ForcedCutBPE(bpe.default_vocabulary())
    own.encode(" ".join(f"w{i}" for i in range(100)))
    assert len(own._pieces) <= 5 and len(own._fragments) <= 5


def test_unsupported_vocabularies_are_refused(tmp_path):
    import json

    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    with pytest.raises(ValueError):
        bpe.ForcedCutBPE(path)
    spec = json.load(open(bpe.default_vocabulary()))
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.ForcedCutBPE(str(tmp_path / "t.json"))


def test_query_matches_the_library(spark, sf):
    from strataquery.llm.queries import op5_bpe

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == token_row(texts[r["doc_id"]])


def test_columns_pass_and_both_ways_agree(spark):
    df = spark.createDataFrame([(1, t, "x") for t in TRICKY], "doc_id long, text string, token_count string")
    once = bpe.round_trip(df).collect()
    twice = bpe.decode_documents(bpe.encode_documents(df)).collect()
    assert sorted(map(str, once)) == sorted(map(str, twice))
    assert {r["decoded"] for r in once} == {t or "" for t in TRICKY}
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_pattern_is_the_public_one():
    import public_tokenizers

    assert regex.compile(public_tokenizers.PATTERN).pattern == bpe.PIECES
