"""Ranking, retention, span and packing operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strataquery.operators.ranges import ahead
from strataquery.shared import cut_lineage
from strataquery.shipping import ship

#: Edit buckets in the order in which the same span prefers them.
PRECEDENCE = ("must_change", "declaration", "override", "likely_change")


def newest(rows: DataFrame, partition: str | None, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each partition in the given order."""
    if partition is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(partition).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def retained_runs(runs: DataFrame, now: Column, *, project: str = "project_id", started: str = "started_at", row: str = "run_id", keep: int = 100, days: int = 30) -> DataFrame:
    """The ``keep`` newest runs of each project that aren't older than ``days``."""
    fresh = runs.where(F.col(started) >= now - F.expr(f"INTERVAL {days} DAYS"))
    return newest(fresh, project, [F.col(started).desc(), F.col(row).desc()], keep)


def latest_finished(runs: DataFrame, *, project: str, started: str, finished: str, row: str) -> DataFrame:
    """project and the id of its latest finished run: one aggregation, no sort."""
    return runs.where(F.col(finished).isNotNull()).groupBy(project).agg(F.max_by(row, F.struct(started, row)).alias(row))


def evicted(slots: DataFrame, limit: int, *, project: str = "project_id", used: str = "last_used_at", slot: str = "slot_id", protected: Column) -> DataFrame:
    """Least recently used slots beyond the limit; protected ones count but stay."""
    counted = slots.withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(project)))
    order = Window.partitionBy(project).orderBy(used, slot)
    free = counted.where(~protected).withColumn("_n", F.row_number().over(order))
    return free.where(F.col("_n") <= F.col("_all") - limit).drop("_n", "_all")


def dedupe_edits(edits: DataFrame, *, bucket: str = "bucket", span: Sequence[str] = ("path", "start_byte", "end_byte"), tie: str = "reference_id", precedence: Sequence[str] = PRECEDENCE) -> DataFrame:
    """One edit a span, the one that comes first in ``precedence``; edits without a span all stay."""
    placed = F.col(span[1]).isNotNull() & F.col(span[2]).isNotNull()
    order = F.array_position(F.array(*map(F.lit, precedence)), F.col(bucket))
    first = Window.partitionBy(*span).orderBy(order, tie)
    kept = edits.where(placed).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return kept.unionByName(edits.where(~placed))


def line_windows(text: Column, size: int = 200, overlap: int = 20) -> Column:
    """Structs (part, start_line, end_line, content) of windows of ``size`` lines that share ``overlap`` lines."""
    step = size - overlap
    lines = F.split(text, "\n")
    starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - 1 - overlap, F.lit(0)), F.lit(step))
    return F.transform(
        starts,
        lambda s, i: F.struct(
            i.alias("part"),
            (s + 1).alias("start_line"),
            F.least(s + size, F.size(lines)).alias("end_line"),
            F.array_join(F.slice(lines, s + 1, F.lit(size)), "\n").alias("content"),
        ),
    )


def bounded_line_windows(text: str, most_chars: int = 4096, most_lines: int = 200, overlap: int = 20) -> list[tuple[int, int, int, int]]:
    """(start, end, first line, last line) of greedy windows: whole lines while both bounds hold.

    A line over ``most_chars`` is cut into fragments of that size, and the
    window after it doesn't reach back into it. Otherwise windows share up to
    ``overlap`` lines, always moving on by at least one.
    """
    lines = text.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    out, i = [], 0
    while i < len(lines):
        if len(lines[i]) > most_chars:
            out += [(a, min(a + most_chars, starts[i + 1]), i + 1, i + 1) for a in range(starts[i], starts[i + 1], most_chars)]
            i += 1
            continue
        end = i
        while end < len(lines) and end - i < most_lines and starts[end + 1] - starts[i] <= most_chars:
            end += 1
        out.append((starts[i], starts[end], i + 1, end))
        if end >= len(lines):
            break
        back = 0 if len(lines[end]) > most_chars else min(overlap, end - i - 1)
        i = end - back
    return out


def token_windows(tokens: Column, length: int, overlap: int) -> Column:
    """Structs (part, first, n_tokens) of windows over ``tokens`` many tokens.

    The overlap is at most half a window, and the last window ends with the text.
    """
    share = max(0, min(overlap, length - 1, length // 2))
    stride = length - share
    starts = F.sequence(F.lit(0), F.greatest(tokens.cast("int") - 1 - share, F.lit(0)), F.lit(stride))
    windows = F.transform(starts, lambda s, i: F.struct(i.alias("part"), s.alias("first"), F.least(F.lit(length), tokens.cast("int") - s).alias("n_tokens")))
    return F.when(tokens > 0, windows).otherwise(F.array().cast("array<struct<part: int, first: int, n_tokens: int>>"))


#: A word with the white space in front of it; the pieces of a text join to the text.
PIECES = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z"


def passage_windows(text: Column, length: int, overlap: int) -> Column:
    """Structs (part, start_char, end_char, n_tokens) of windows of ``length`` words, placed by ``token_windows``.

    An empty text has one empty window.
    """
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    upto = lambda p, n: F.length(F.array_join(F.slice(p, F.lit(1), n), ""))
    placed = lambda p: F.transform(
        token_windows(F.size(p), length, overlap),
        lambda w: F.struct(w["part"].alias("part"), upto(p, w["first"]).alias("start_char"), upto(p, w["first"] + w["n_tokens"]).alias("end_char"), w["n_tokens"].alias("n_tokens")),
    )
    none = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("start_char"), F.lit(0).alias("end_char"), F.lit(0).alias("n_tokens")))
    return F.transform(F.array(pieces), lambda p: F.when(F.size(p) > 0, placed(p)).otherwise(none))[0]


def window_chunks(chunks: DataFrame, windows: str, content: str = "content") -> DataFrame:
    """A chunk for each window in the array ``windows``: its content, and its bytes and lines in the source.

    Places follow from the window's characters and the chunk's own place, so
    the file isn't read again. A chunk that one window covers is as it was.
    """
    each = chunks.withColumn("_w", F.explode(windows))
    start, end = F.col("_w")["start_char"], F.col("_w")["end_char"]
    head, own = F.substring(F.col(content), F.lit(1), start), F.substring(F.col(content), start + 1, end - start)
    lines = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    each = each.withColumns({"_head": head, "_own": own, "part_index": F.col("_w")["part"]})
    first_byte, first_line = F.col("start_byte") + F.octet_length("_head"), F.col("start_line") + lines(F.col("_head"))
    places = {"start_byte": first_byte, "end_byte": first_byte + F.octet_length("_own"), "start_line": first_line, "end_line": first_line + lines(F.col("_own"))}
    cut = (start > 0) | (end < F.length(content))
    return each.withColumns({k: F.when(cut, v).otherwise(F.col(k)) for k, v in places.items()}).withColumn(content, F.col("_own")).drop("_w", "_head", "_own", windows)


def greedy_batches(sizes: Sequence[int], most_items: int, most_size: int) -> list[int]:
    """Batch number of each item in order: a batch closes before the item that would break a bound; an item over the bound is alone."""
    out, batch, items, size = [], 0, 0, 0
    for s in sizes:
        if items and (items >= most_items or size + s > most_size):
            batch, items, size = batch + 1, 0, 0
        out.append(batch)
        items, size = items + 1, size + s
    return out


def padded_batches(tokens: Sequence[int], most_items: int, most_product: int) -> list[int]:
    """Batch number of each item: items of one length bucket (by bits), bounded by number and by number times the longest."""
    out, batch = [0] * len(tokens), -1
    items = longest = bucket = None
    for i in sorted(range(len(tokens)), key=lambda j: (max(tokens[j], 0).bit_length(), j)):
        t, bits = tokens[i], max(tokens[i], 0).bit_length()
        if bits != bucket or items >= most_items or (items + 1) * max(longest, t) > most_product:
            batch, items, longest, bucket = batch + 1, 0, 0, bits
        out[i], items, longest = batch, items + 1, max(longest, t)
    return out


#: Rows of a group that one task packs.
PIECE = 50_000


def _batch_end(sizes: Sequence[int], at: int, most_items: int, most_size: int, padded: bool) -> int:
    """Where the batch that starts at ``at`` ends, as ``greedy_batches`` and ``padded_batches`` (in order of bucket) close them."""
    end, total, longest, bits = at, 0, 0, max(sizes[at], 0).bit_length()
    while end < len(sizes) and end - at < most_items:
        size = sizes[end]
        if padded:
            longest = max(longest, size)
            if max(size, 0).bit_length() != bits or (end > at and (end - at + 1) * longest > most_size):
                break
        elif end > at and total + size > most_size:
            break
        total, end = total + size, end + 1
    return end


def pack(rows: DataFrame, group: str, order: str, size: str, *, most_items: int, most_size: int, padded: bool = False) -> DataFrame:
    """``group``, ``order``, ``size`` and the batch of each row, packed in order inside each group.

    A batch depends on where the one before it ended, but on no more than
    ``most_items`` rows. So a group is cut into pieces of ``PIECE`` rows. For
    each place among the first ``most_items`` of a piece where a batch may
    start, a task finds where the last batch of the piece then ends; the pieces
    are chained by those answers; and each piece is packed from its own start.
    ``padded`` batches take rows of one length bucket (by bits) at a time.
    """
    ship(rows.sparkSession)
    slim = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(size).cast("long").alias("s"))
    bucket = F.when(F.col("s") > 0, F.length(F.bin("s"))).otherwise(0)
    placed = ahead(slim.withColumn("b", bucket if padded else F.lit(0)), "g", ["b", "o"], into="at")
    own = F.floor(F.col("at") / PIECE)
    with_next = F.when((F.col("at") % PIECE < most_items) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    pieces = cut_lineage(placed.withColumn("piece", F.explode(with_next)))

    def sizes_of(frame: pd.DataFrame) -> tuple[pd.DataFrame, list[int], int]:
        frame = frame.sort_values("at", kind="stable")
        return frame, frame["s"].tolist(), int((frame["at"] // PIECE == frame["piece"]).sum())

    def exits(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, sizes, count = sizes_of(frame)
        known: dict[int, tuple[int, int]] = {}
        for start in range(min(most_items, count)):
            at, path = start, []
            while at < count and at not in known:
                path.append(at)
                at = _batch_end(sizes, at, most_items, most_size, padded)
            end, batches = known.get(at, (at, 0))
            for i, p in enumerate(reversed(path), 1):
                known[p] = end, batches + i
        return pd.DataFrame([(*key, e, known[e][0] - count, known[e][1]) for e in range(min(most_items, count))], columns=["g", "piece", "entry", "exit", "batches"])

    def chained(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        by = {(p, e): (x, n) for p, e, x, n in zip(frame["piece"], frame["entry"], frame["exit"], frame["batches"])}
        out, entry, batch = [], 0, 0
        for piece in sorted(set(frame["piece"])):
            out.append((*key, piece, entry, batch))
            entry, more = by.get((piece, entry), (0, 0))  # a last piece may end before the batch that began in front of it
            batch += more
        return pd.DataFrame(out, columns=["g", "piece", "entry", "batch"])

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame, sizes, count = sizes_of(frame)
        at, batch = int(frame["entry"].iloc[0]), int(frame["batch"].iloc[0])
        out = [batch - 1] * min(at, count)
        while at < count:
            end = _batch_end(sizes, at, most_items, most_size, padded)
            out += [batch] * (min(end, count) - at)
            at, batch = end, batch + 1
        return frame.iloc[:count].assign(batch=out)[["g", "o", "s", "batch"]]

    kinds = {f.name: f.dataType for f in pieces.schema.fields}
    schema = lambda *names: StructType([StructField(n, kinds.get(n, LongType())) for n in names])
    answers = pieces.select("g", "piece", "at", "s").groupBy("g", "piece").applyInPandas(exits, schema("g", "piece", "entry", "exit", "batches"))
    starts = answers.groupBy("g").applyInPandas(chained, schema("g", "piece", "entry", "batch"))  # most_items rows a piece
    starts = starts.select(F.col("g").alias("g2"), F.col("piece").alias("p2"), "entry", "batch")
    both = pieces.join(starts, F.col("g").eqNullSafe(F.col("g2")) & (F.col("piece") == F.col("p2"))).select("g", "piece", "at", "o", "s", "entry", "batch")
    out = both.groupBy("g", "piece").applyInPandas(packed, schema("g", "o", "s", "batch"))
    return out.select(F.col("g").alias(group), F.col("o").alias(order), F.col("s").alias(size), "batch")


def windows_of_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, part, start, end, start_line, end_line of the greedy line windows of each text."""
    ship(rows.sparkSession)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(k, part, *w) for k, t in zip(frame.iloc[:, 0], frame.iloc[:, 1]) for part, w in enumerate(bounded_line_windows(t or ""))], columns=["key", "part", "start", "end", "start_line", "end_line"])

    return rows.select(F.col(key).cast("long").alias("key"), F.col(text)).mapInPandas(cut, "key long, part long, start long, end long, start_line long, end_line long")
