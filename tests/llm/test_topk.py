import math
import random

import numpy as np
import pytest

from strataquery.llm import topk

SCHEMA = "vec_id long, embedding array<float>, id string, vector string, part string, chunk string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def brute(rows, queries, k, scale=256):
    def ints(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(scale * float(np.float32(x))) for x in v]

    use = [(i, ints(v)) for i, v in rows if i is not None and ints(v) is not None]
    asked = {}
    for i, v in queries:
        if i is not None and ints(v) is not None:
            asked[i] = min(asked.get(i, ints(v)), ints(v))
    out = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in use if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def check(spark, rows, queries, k=5):
    got = topk.top_k(table(spark, rows), table(spark, queries), k=k)
    assert sorted(map(tuple, got.collect())) == brute(rows, queries, k)


def vectors(rng, n, width=8, centres=5):
    mids = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    return [(i, [m + rng.gauss(0, 0.2) for m in rng.choice(mids)]) for i in range(n)]


@pytest.mark.parametrize("block,group,chunk,floor", [(256, 64, 8192, 16), (4, 2, 3, 1), (1, 1, 1, 1)])
def test_against_all_pairs(spark, monkeypatch, block, group, chunk, floor):
    for name, value in (("BLOCK", block), ("GROUP", group), ("CHUNK", chunk), ("FLOOR_BLOCKS", floor)):
        monkeypatch.setattr(topk, name, value)
    rows = vectors(random.Random(block), 60)
    check(spark, rows, rows[::10])


def test_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    rows = [(i, [0.5, 0.25]) for i in range(40)] + [(100 + i, [0.0, 0.0]) for i in range(5)]
    check(spark, rows, rows[::7])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (2, None), (3, []), (4, [0.3]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [-0.4, 0.9, 0.1]), (9, [0.0, -0.001]), (9, [0.2, 0.2]), (1, [0.1, 0.2])]
    check(spark, rows, rows)
    check(spark, rows, rows, k=2)
    empty = table(spark, rows).limit(0)
    assert topk.top_k(empty, empty).count() == 0
    assert topk.top_k(empty, table(spark, rows)).count() == 0
    assert topk.top_k(table(spark, rows), empty).count() == 0


def test_pruning_skips_blocks_and_loses_nothing():
    rng = np.random.default_rng(3)
    mids = rng.normal(size=(20, 16)) * 300
    rows = np.floor(np.concatenate([m + rng.normal(size=(64, 16)) * 20 for m in mids]))
    ids = np.arange(len(rows))
    blocks = [(ids[i : i + 64], rows[i : i + 64]) for i in range(0, len(rows), 64)]
    asked = rows[::97]
    found, scored = topk.search(asked, ids[::97], blocks, 5, np.full(len(asked), -np.inf))
    want = []
    for q, v in zip(ids[::97], asked):
        want += [(q, i, s) for s, i in sorted(((int(v @ w), int(i)) for i, w in zip(ids, rows) if i != q), key=lambda x: (-x[0], x[1]))[:5]]
    assert sorted(found) == sorted(want)
    assert scored < 0.5 * len(blocks) * len(asked)


def test_large_scores_are_ranked_exactly(spark):
    """Finite vectors whose scores pass 2**53 and the longs; those beyond a long are given as the nearest one."""
    rng = random.Random(8)
    for size in (1e7, 1e9, 1e300):
        rows = [(i, [float(np.float32(size)) * rng.choice([-1, 1, 0.5, 0.25]) if size < 1e30 else size * rng.random() for _ in range(4)]) for i in range(30)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        whole = {i: [math.floor(256 * x) if abs(256 * x) < float("inf") else 0 for x in v] for i, v in rows}
        want = []
        for q in range(0, 30, 10):
            best = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)[:5]
            want += [(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(best)]
        assert sorted(map(tuple, topk.top_k(df, df.where("vec_id % 10 = 0")).collect())) == want


def test_group_bounds_keep_most_queries_from_most_groups(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "GROUP", 2)
    sent, real = [], topk._searched

    def seen(placed, requests, *rest):
        sent.append(requests.count())
        return real(placed, requests, *rest)

    monkeypatch.setattr(topk, "_searched", seen)
    rng = random.Random(5)
    mids = [[rng.choice([-3, 3]) for _ in range(8)] for _ in range(20)]
    rows = [(20 * j + i, [m + rng.gauss(0, 0.1) for m in mids[i]]) for i in range(20) for j in range(20)]
    check(spark, rows, rows[::9])
    groups, queries = math.ceil(len(rows) / 16), len(rows[::9])
    assert len(sent) == 2 and sum(sent) < 0.3 * groups * queries


@pytest.mark.parametrize("bounds", [1, 3])
def test_runs_of_groups(spark, monkeypatch, bounds):
    for name, value in (("BLOCK", 2), ("GROUP", 2), ("CHUNK", 5), ("BOUNDS", bounds)):
        monkeypatch.setattr(topk, name, value)
    rows = vectors(random.Random(bounds), 50)
    check(spark, rows, rows[::5])


def test_query_matches_sql(spark, sf, duck):
    from strataquery.llm.queries import oracle_sql, queries

    got = queries()["op10_topk"](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(oracle_sql()["op10_topk"]).fetchall())
