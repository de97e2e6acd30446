import random

import pytest

from strataquery.llm import mixing
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, size string, h string, copies string, id string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, s, "x", "y", "z", "i") for d, s, t in rows], SCHEMA)


def check(spark, rows):
    size, target, taken = brute.mix(rows)
    got = sorted(((r["doc_id"], r["source"], r["size"], r["taken"]) for r in mixing.mix(table(spark, rows)).collect()), key=str)
    assert got == sorted(((d, s, n, t) for (d, s, _), n, t in zip(rows, size, taken)), key=str)
    aims = {r["source"]: r["target"] for r in mixing.mix(table(spark, rows)).collect()}
    for (_, s, _), t in zip(rows, target):
        assert aims[s] == pytest.approx(t)


def some_rows(seed, n, sources):
    rng = random.Random(seed)
    return [(i, rng.choice(sources), " ".join(["w"] * rng.choice([0, 1, 3, 10, 200]))) for i in range(n)]


@pytest.mark.parametrize("sources", [["a"], ["a", "b", "c"], ["z", "é", None, "B", "a", ""], ["hot"] * 20 + ["a", "b"]])
def test_against_the_plain_version(spark, sources):
    check(spark, some_rows(len(sources), 300, sources))


def test_many_ranges_of_one_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 8)
    check(spark, some_rows(7, 400, ["hot"] * 5 + ["a", "b", "c"]))


def test_targets_are_met(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs).collect()
    most = max(r["size"] for r in rows)
    taken, target = {}, {}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s in taken:
        assert abs(taken[s] - target[s]) <= most
    assert sum(taken.values()) <= 1.5 * sum(r["size"] for r in rows)


def test_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    once = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert once == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)


def test_odd_rows(spark):
    rows = [(None, None, None), (None, "a", "x y"), (None, "a", "x y"), (1, "a", ""), (1, "a", ""), (2, None, "k " * 50_000), (3, "b", " \n\t")]
    check(spark, rows)
    assert mixing.mix(table(spark, rows).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(table(spark, [(1, "a", ""), (2, "b", None)])).collect()] == [0, 0]


def test_mixture_holds_each_row_as_often_as_taken(spark):
    rows = some_rows(11, 120, ["a", "b", None])
    df = table(spark, rows)
    _, _, taken = brute.mix(rows)
    size = {d: len(t.split()) for d, _, t in rows}
    want = sorted(d for (d, _, _), n in zip(rows, taken) if n for _ in range(n // size[d]))
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == want


def test_mixture_of_repeated_ids_holds_what_is_taken(spark):
    rng = random.Random(4)
    texts = [" ".join(["w"] * n) for n in (4, 4, 7, 3)]
    rows = [(rng.choice([None, None, 1, 2]), rng.choice(["a", "b"]), rng.choice(texts)) for _ in range(230)] + [(None, "a", "x y z u")] * 40
    _, _, taken = brute.mix(rows)
    want = {}
    for (d, s, t), n in zip(rows, taken):
        want[d, s, t] = want.get((d, s, t), 0) + n // len(t.split())
    got = {}
    for r in mixing.mixed_documents(table(spark, rows)).collect():
        got[r["doc_id"], r["source"], r["text"]] = got.get((r["doc_id"], r["source"], r["text"]), 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_query_matches_sql(spark, sf, duck):
    from strataquery.llm.queries import oracle_sql, queries

    got = sorted(tuple(r) for r in queries()["op3_fair_mix"](spark, sf).collect())
    assert got == sorted(duck.sql(oracle_sql()["op3_fair_mix"]).fetchall())
