import random

import pytest
from pyspark.sql import functions as F

from strataquery.llm import simhash
from tests.llm import brute

SCHEMA = "doc_id long, text string, fp string, root string, id string, row string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def table(spark, pairs):
    return spark.createDataFrame([(i, t, "x", "y", "z", "r") for i, t in pairs], SCHEMA)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "A B c", "é É b c d", "a\x0bb\x0cc\x1cd e f"])
def test_fingerprints(text):
    assert simhash.simhash(text) == brute.fingerprint(text)


def test_long_text_in_strides(monkeypatch):
    text = " ".join(random.Random(3).choices(WORDS, k=5000))
    monkeypatch.setattr(simhash, "STRIDE", 77)
    assert simhash.simhash(text) == brute.fingerprint(text)


def test_query_matches_all_pairs(spark, sf):
    from strataquery.llm.queries import op6_simhash

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    prints = [brute.fingerprint(t) for _, t in docs]
    least, _ = brute.groups([i for i, _ in docs], prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op6_simhash(spark, sf).collect()}
    assert got == {i: (f"{p:016x}", c) for (i, _), p, c in zip(docs, prints, least)}


def linked(spark, prints, distance):
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    edges = [(r["a"], r["b"]) for r in simhash.links(df, distance).collect()]
    for a, b in edges:
        assert 0 < ((a ^ b) & (1 << 64) - 1).bit_count() <= distance
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, distance)).collect()}
    want, _ = brute.groups([signed(p) for p in prints], prints, distance)
    assert {signed(p): roots.get(signed(p), signed(p)) for p in prints} == {signed(p): w for p, w in zip(prints, want)}
    return edges


@pytest.mark.parametrize("distance", [1, 2])
def test_links_of_random_neighbourhoods(spark, distance):
    rng = random.Random(distance)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 8, 30])):
            p = base
            for _ in range(rng.randrange(5)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    linked(spark, sorted(prints), distance)


def test_crowded_variants_give_no_pairs(spark):
    """300 fingerprints within two bits of each other, all under the same variants."""
    base = random.Random(9).getrandbits(64)
    prints = sorted({base ^ (1 << i) ^ (1 << j) for i in range(32) for j in range(i, 32)})[:300]
    edges = linked(spark, prints, 2)
    assert len(edges) < 70 * len(prints)


def test_links_across_the_cut(spark):
    """One bit in each segment, and two in the same one."""
    a = 0x0123456789ABCDEF
    linked(spark, [a, a ^ 1 ^ (1 << 63), a ^ 6, (a ^ 6) ^ (3 << 40), 0, 1, 3, 7, 1 << 63], 2)


def test_odd_rows(spark):
    text = " ".join(WORDS)
    rows = [(5, text), (3, text), (None, text), (3, text), (9, None), (8, ""), (7, " \t"), (None, None), (1, "lone text here")]
    df = table(spark, rows)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (9, 7), (8, 7), (7, 7), (None, 7), (1, 1)], key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 7]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_groups_without_ids_keep_one(spark):
    df = table(spark, [(None, "a b c d"), (None, "a b c d"), (None, "other words here now")])
    assert sorted(r["text"] for r in simhash.keep_one(df).collect()) == ["a b c d", "other words here now"]


def test_one_group_of_a_third(spark):
    rng = random.Random(2)
    pairs = [(i, " ".join(WORDS)) for i in range(300)] + [(1000 + i, " ".join(rng.choices(WORDS, k=40))) for i in range(600)]
    got = simhash.near_duplicates(table(spark, pairs))
    assert got.where(F.col("component_id") == 0).count() == 300


def test_keep_one_keeps_one_of_each_group(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    least, _ = brute.groups([i for i, _ in rows], [brute.fingerprint(t) for _, t in rows])
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(set(least))
