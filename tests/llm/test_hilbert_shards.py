import math
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataquery.llm import hilbert_shards as h

SCHEMA = "doc_id long, lang string, source string, n_chars long, size long, shard string, row string, tie0 string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


@pytest.mark.parametrize("dims,bits", [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_each_cell_once_in_steps_of_one(dims, bits):
    cells = np.array(list(product(range(1 << bits), repeat=dims)))
    place = h.hilbert_index(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def rows_of(n):
    return [(i, ["en", "de", None][i % 3], f"src{i % 7}" if i % 11 else None, None if i % 13 == 0 else (i * 37) % 5000 - 10, i % 50 + 1) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 250])
@pytest.mark.parametrize("shards", [1, 8])
def test_law_of_rows(spark, n, shards):
    df = table(spark, rows_of(n))
    got = h.hilbert_shards(df, {"lang": "hash", "source": "hash", "n_chars": "log"}, shards=shards, ties=["doc_id"]).collect()
    assert len(got) == n
    if not n:
        return
    assert set(got[0].asDict()) == {"doc_id", "lang", "source", "n_chars", "size", "row", "tie0", "curve_index", "shard", "slot"}
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    last = -1
    for s in sorted(by):
        run = sorted(by[s], key=lambda r: r["slot"])
        assert [r["slot"] for r in run] == list(range(len(run)))
        for r in run:
            assert r["curve_index"] >= last
            last = r["curve_index"]


def test_law_of_bytes(spark):
    df = table(spark, rows_of(400))
    got = h.hilbert_shards(df, {"lang": "hash", "n_chars": "log"}, shards=5, ties=["doc_id"], law="bytes", size="size").collect()
    total = [sum(r["size"] for r in got if r["shard"] == s) for s in range(5)]
    assert max(total) - min(total) <= 2 * 50
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_many_parts_and_one_crowded_cell(spark, monkeypatch):
    monkeypatch.setattr(h, "RANGE_ROWS", 10)
    rows = [(i, "en", "hot", 100, 1) for i in range(200)] + rows_of(100) + [(0, "en", "hot", 100, 1)] * 50
    got = h.hilbert_shards(table(spark, rows), {"lang": "hash", "source": "hash", "n_chars": "log"}, ties=["doc_id"]).collect()
    counts = [sum(r["shard"] == s for r in got) for s in range(8)]
    assert len(got) == 350 and max(counts) - min(counts) <= 1


def test_wrong_arguments(spark):
    df = table(spark, rows_of(3))
    with pytest.raises(ValueError):
        h.hilbert_shards(df, {"lang": "hash"}, law="bytes")
    with pytest.raises(ValueError):
        h.hilbert_shards(df, {"lang": "name"})
    with pytest.raises(ValueError):
        h.hilbert_shards(df, {"lang": "hash", "source": "hash"}, bits=40)


def brute_shards(rows, names, shards=8, bits=6):
    """(shard, slot) by doc_id of (doc_id, lang, source, n_chars, tie) rows, from one sorted list."""
    ranks = []
    for column in (1, 2):
        known = sorted({r[column] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
        ranks.append({v: i * (1 << bits) // len(known) for i, v in enumerate(known)})
    log = lambda n: 0 if n is None else min((1 << bits) - 1, math.floor(math.log2(1 + max(n, 0)) * (1 << bits) / 40))
    cells = np.array([(ranks[0][r[1]], ranks[1][r[2]], log(r[3])) for r in rows])
    place = h.hilbert_index(cells, bits)
    order = sorted(range(len(rows)), key=lambda i: (place[i], rows[i][4], rows[i][0]))
    out, first = {}, {}
    for rank, i in enumerate(order):
        shard = shards * rank // len(rows)
        out[rows[i][0]] = (shard, rank - first.setdefault(shard, rank))
    return out


def test_written_shards_prune(spark, tmp_path, sf):
    """Most files can be skipped by the minima and maxima of any one dimension."""
    rows = [(i, f"lang{i % 12:02d}", f"src{i * 7 % 40:02d}", 2 ** (i * 13 % 16), 1) for i in range(4000)]
    cut = h.hilbert_shards(table(spark, rows).drop("shard"), {"lang": "rank", "source": "rank", "n_chars": "log"}, shards=8, ties=["doc_id"])
    h.write_shards(cut, str(tmp_path / "out"), rows_per_file=50)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4000 and back.select("shard").distinct().count() == 8
    files = back.groupBy(F.input_file_name()).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("lang", "source", "n_chars") for f in (F.min, F.max)]).collect()
    assert 80 <= len(files) <= 100
    for c, value in (("lang", "lang05"), ("source", "src21"), ("n_chars", 2**9)):
        read = sum(r[f"min_{c}"] <= value <= r[f"max_{c}"] for r in files)
        assert read < 0.45 * len(files), (c, read)


def test_more_names_than_are_ranked(spark, monkeypatch):
    monkeypatch.setattr(h, "NAMES", 10)
    rows = [(i, "en", ["zeta", "alpha", "mid", None, "é", ""][i % 6] + str(i) if i % 6 != 3 else None, 5, 1) for i in range(90)]
    got = h.hilbert_shards(table(spark, rows), {"source": "rank"}, shards=3, ties=["doc_id"]).orderBy("curve_index").collect()
    firsts = [(r["source"] or "")[:1] for r in got]
    assert firsts[:15] == [""] * 15 and firsts.index("a") < firsts.index("m") < firsts.index("z")


def test_thousands_of_names_are_ranked_like_few(spark):
    rows = [(i, ["en", None, "de"][i % 3], f"source{i * 7 % 5000:05d}", i % 9, 1) for i in range(5200)]
    got = h.hilbert_shards(table(spark, rows), {"lang": "rank", "source": "rank", "n_chars": "log"}, ties=["doc_id"]).collect()
    want = brute_shards([(*r[:4], r[0]) for r in rows], ["lang", "source"])
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == want


@pytest.mark.parametrize("n,bits", [(0, 6), (1, 6), (3, 1), (40, 6), (64, 6), (65, 6), (300, 6), (300, 20)])
@pytest.mark.parametrize("null", [True, False])
def test_cells_of_names(spark, monkeypatch, n, bits, null):
    """Cells follow the ranks, whether names stand in the plan or are joined; also of names that aren't UTF-8."""
    names = sorted([b"", b"\xff", b"\xfe\xff", "é".encode(), b"a", b"a\x00"][:n] + [f"n{i}".encode() for i in range(n - 6)])
    names = [None] * null + names
    df = spark.createDataFrame([(v if v is None else bytearray(v),) for v in names * 2], "b binary").select("b", F.col("b").cast("string").alias("value0"))
    want = {v: max(i * (1 << bits) // len(names), null and v is not None) for i, v in enumerate(names)}
    for most in (256, 0):
        monkeypatch.setattr(h, "NAMES", most)
        got = h.ranked_cells(df, "value0", bits, "cell0").collect()
        assert len(got) == len(names) * 2 and all(want[r["b"] if r["b"] is None else bytes(r["b"])] == r["cell0"] for r in got)


def test_query(spark, sf):
    from strataquery.llm.queries import op2_hilbert_shards

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op2_hilbert_shards(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    crc = {i: zlib.crc32(r["text"].encode()) for i, r in docs.items()}
    want = brute_shards([(i, r["lang"], r["source"], r["n_chars"], crc[i]) for i, r in docs.items()], ["lang", "source"])
    for r in got:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(docs[r["doc_id"]]["text"].encode()) + 1, crc[r["doc_id"]], "rows", None)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == want
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, op2_hilbert_shards(spark, sf).collect()), key=str)
