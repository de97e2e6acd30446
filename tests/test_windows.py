import random

import pytest
from pyspark.sql import functions as F

from strataquery.operators import metrics, paging, windows
from strataquery.errors import EngineError


def test_line_windows_cover_and_respect_bounds():
    rng = random.Random(0)
    for _ in range(60):
        text = "".join("x" * rng.choice([0, 3, 30, 200, 900]) + "\n" for _ in range(rng.randrange(1, 60)))
        cut = windows.bounded_line_windows(text, 400, 10, 3)
        covered = set()
        for a, b, first, last in cut:
            assert 0 <= b - a <= 400 and last - first < 10
            covered.update(range(a, b))
        assert covered == set(range(len(text)))
        assert all(x[0] < y[0] for x, y in zip(cut, cut[1:]))


def test_line_windows_do_not_reach_back_into_a_wide_line():
    text = "a\nb\n" + "w" * 50 + "\nc\nd\n"
    cut = windows.bounded_line_windows(text, 20, 10, 2)
    assert [text[a:b] for a, b, _, _ in cut] == ["a\nb\n", "w" * 20, "w" * 20, "w" * 10 + "\n", "c\nd\n"]
    assert windows.bounded_line_windows("") == []


@pytest.mark.parametrize("n,length,overlap", [(0, 8, 2), (1, 8, 2), (8, 8, 2), (9, 8, 2), (100, 8, 7), (100, 8, 0), (5, 1, 3)])
def test_token_windows_cover_all_tokens(spark, n, length, overlap):
    got = spark.range(1).select(F.explode(windows.token_windows(F.lit(n), length, overlap)).alias("w")).select("w.*").collect()
    covered = {t for w in got for t in range(w["first"], w["first"] + w["n_tokens"])}
    assert covered == set(range(n)) and all(0 < w["n_tokens"] <= length for w in got)
    if len(got) > 1:
        assert got[-1]["first"] + got[-1]["n_tokens"] == n


def test_greedy_packing():
    assert windows.greedy_batches([1, 2, 3, 10, 1], 2, 5) == [0, 0, 1, 2, 3]
    assert windows.greedy_batches([9], 2, 5) == [0]
    rng = random.Random(1)
    tokens = [rng.randrange(1, 600) for _ in range(200)]
    batches = windows.padded_batches(tokens, 8, 2048)
    for b in set(batches):
        own = [t for t, x in zip(tokens, batches) if x == b]
        assert len(own) <= 8 and (len(own) == 1 or len(own) * max(own) <= 2048) and len({t.bit_length() for t in own}) == 1


def test_cursors():
    state = {"version": 3, "question": paging.digest({"a": 1})}
    cursor = paging.encode_cursor(state | {"offset": 20})
    assert paging.decode_cursor(cursor, state) == 20
    with pytest.raises(EngineError) as error:
        paging.decode_cursor(cursor, state | {"version": 4})
    assert error.value.code == "STALE_CURSOR"
    for bad in ("", "%%%", "aGVsbG8", paging.encode_cursor(state | {"offset": -1}), paging.encode_cursor(state | {"offset": True}), paging.encode_cursor([1])):
        with pytest.raises(EngineError) as error:
            paging.decode_cursor(bad, state)
        assert error.value.code == "INVALID_CURSOR"


@pytest.mark.parametrize(
    "a,b,tau",
    [(["x", "y", "z"], ["x", "y", "z"], 1.0), (["x", "y", "z"], ["z", "y", "x"], -1.0), (["x"], ["x"], 1.0), (["x", "y"], ["x", "q"], 1 / 2**0.5 / 2**0.5), (["x", "y", "z"], ["x", "z", "y"], 1 / 3)],
)
def test_rank_correlation(spark, a, b, tau):
    ranking = lambda keys: spark.createDataFrame([(1, k, i + 1) for i, k in enumerate(keys)], "query long, key string, rank long")
    got = metrics.rank_correlation(ranking(a), ranking(b)).first()["tau"]
    if len(set(a) ^ set(b)) == 0:
        assert got == pytest.approx(tau)
    assert -1 <= got <= 1


def test_best_batch():
    assert metrics.best_batch([(1, 10), (2, 15), (4, 15.5), (8, 40)]) == 2
    assert metrics.best_batch([(1, 10), (2, 20)]) == 2


def test_edits_without_span_all_stay(spark):
    rows = [("p", 1, 2, "a", "likely_change"), ("p", 1, 2, "b", "must_change"), ("p", None, None, "c", "review"), ("p", None, None, "d", "review"), ("q", 1, 2, "e", "override")]
    df = spark.createDataFrame(rows, "path string, start_byte long, end_byte long, reference_id string, bucket string")
    assert sorted(r["reference_id"] for r in windows.dedupe_edits(df).collect()) == ["b", "c", "d", "e"]


def test_pack_in_pieces_equals_the_plain_batches(spark, monkeypatch):
    import random

    monkeypatch.setattr(windows, "PIECE", 7)
    rng = random.Random(4)
    for padded in (False, True):
        for most_items, most_size in ((3, 40), (5, 10_000), (1, 5), (9, 30)):
            rows = [(g, i, rng.choice([0, 1, 5, 9, 17, 33, 200])) for g, n in (("a", 61), ("b", 3), (None, 15), ("c", 7)) for i in range(n)]
            got = windows.pack(spark.createDataFrame(rows, "g string, i long, s long"), "g", "i", "s", most_items=most_items, most_size=most_size, padded=padded).collect()
            plain = windows.padded_batches if padded else windows.greedy_batches
            for g in ("a", "b", None, "c"):
                own = sorted((r["i"], r["s"], r["batch"]) for r in got if r["g"] == g)
                assert [b for *_, b in own] == plain([s for _, s, _ in own], most_items, most_size), (padded, most_items, g)


def test_positions_over_small_ranges(spark, monkeypatch):
    from strataquery.operators import ranges

    monkeypatch.setattr(ranges, "RANGE_ROWS", 5)
    rows = [(g, i, i % 3 + 1) for g, n in (("a", 40), (None, 7), ("b", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long, w long")
    got = {(r["g"], r["i"]): r["ahead"] for r in ranges.ahead(df, "g", ["i"]).collect()}
    assert got == {(g, i): i for g, i, _ in rows}
    got = {(r["g"], r["i"]): r["ahead"] for r in ranges.ahead(df, "g", ["i"], weight="w").collect()}
    assert got == {(g, i): sum(k % 3 + 1 for k in range(i)) for g, i, _ in rows}
