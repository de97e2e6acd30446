import itertools
import random
from collections import defaultdict

import pytest

import corpus_pipeline
from strataquery.llm import near_copies, simhash
from tests.llm import brute

SCHEMA = "doc_id long, text string, key string, n string, first string, row string"


def table(spark, pairs):
    return spark.createDataFrame([(i, t, "x", "y", "z", "r") for i, t in pairs], SCHEMA)


def copies(rng, base, n):
    """Copies of ``base`` with one word replaced in each, so a similarity of more than 0.8."""
    for _ in range(n):
        words = list(base)
        words[rng.randrange(len(words))] = f"new{rng.random()}"
        yield " ".join(words)


@pytest.mark.parametrize("size", [3, 40])
def test_stage_drops_near_copies_more_than_two_bits_apart(spark, size):
    rng = random.Random(size)
    base = [f"w{rng.randrange(10_000)}" for _ in range(80)]
    texts = [" ".join(base), *copies(rng, base, size)]
    assert any((simhash.simhash(texts[0]) ^ simhash.simhash(t)).bit_count() > 2 for t in texts)
    rows = list(enumerate(texts)) + [(100 + i, " ".join(f"v{rng.randrange(10_000)}" for _ in range(80))) for i in range(20)]
    kept = corpus_pipeline.near_dedup(spark, table(spark, rows), "")
    assert kept.columns == table(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, *range(100, 120)]


def test_less_similar_texts_stay(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base)), (1, " ".join(base[:86] + [f"x{i}" for i in range(14)]))]  # 82 of 110
    assert sorted(r["doc_id"] for r in near_copies.keep_one(table(spark, rows)).collect()) == [0, 1]


def test_all_pairs_of_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute.near_groups(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == want


def test_odd_rows(spark):
    text = "one two three four five six"
    df = table(spark, [(5, text), (3, text.upper()), (None, text), (3, text.upper()), (9, None), (8, ""), (7, " \t"), (None, None), (1, "lone text"), (None, "a b"), (None, "a b")])
    assert sorted((r["doc_id"] for r in near_copies.keep_one(df).collect()), key=str) == [1, 3, 7, None]
    assert near_copies.keep_one(df.limit(0)).count() == 0


def linked_groups(rows):
    """Smallest id of each group, if texts link that share a variant and are similar; all pairs are compared."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [set(near_copies.shingles(w).tolist()) for w in words]
    keys = [{(s, b, v & ~(1 << b)) for s, v in enumerate(near_copies.word_print(w)) for b in range(32)} for w in words]
    roots = list(range(len(rows)))

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    pairs = 0
    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and keys[i] & keys[j]:
            roots[find(i)] = find(j)
            pairs += 1
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    return sorted(min(g) for g in groups.values()), pairs


@pytest.mark.parametrize("seed,most", [(1, 12), (2, 25), (3, 40)])
def test_no_link_is_lost_in_crowds(spark, seed, most):
    """Copies of one text with few to many words replaced: many meet under a variant, not all are similar, and chains join some."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    texts = [base]
    while len(texts) < 120:
        own = list(rng.choice(texts))
        for _ in range(rng.randrange(1, most)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10**9)}"
        texts.append(own)
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want, pairs = linked_groups(rows)
    assert pairs > 3
    assert sorted(r["doc_id"] for r in near_copies.keep_one(table(spark, rows)).collect()) == want


def test_shared_rows_of_a_range_in_small_batches():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    variant = np.sort(np.array([rng.randrange(60) for _ in range(80)]))
    for size in (1, 2, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(variant[i : i + size]), pa.array(np.arange(80)[i : i + size])], names=["variant", "key"]) for i in range(0, 80, size)]
        got = [k for b in simhash._runs(iter(batches)) for k in b.column(1).to_pylist()]
        counts = np.bincount(variant)
        assert got == [k for k, v in enumerate(variant) if counts[v] > 1 or v in (variant[0], variant[-1])]
    assert list(simhash._runs(iter([]))) == []
