"""Near copies: SimHash over words, deletion variants, five-word shingles (operator 6 for texts that differ in more than 2 bits).

Two texts are compared if their 128-bit fingerprints share a variant, and
linked if the sets of their five-word shingles (words in lower case, ASCII
only) have a Jaccard similarity of ``LEAST`` or more. Groups are the connected
components of the links.

The fingerprint is the SimHash of a text's distinct words, as a changed word
moves it far less than one of shingles. It is cut into four segments of 32
bits; each is indexed under its 32 one-wildcard variants, and equal variants
meet. So every pair that differs in 7 bits or fewer meets for certain, and
texts of similarity 0.8 or more, which mostly differ in 4 to 14 bits, meet as
the README states.

Texts with the same words are one class. Pairs under a variant aren't
expanded. A variant's pivot is the member that meets most others; each class is
first compared with its nearest pivot and its best connected one, then with
all pivots in other groups. That joins nearly all of a group in pairs linear
in its members. Then the rest is done in full: under each variant that still
holds classes of different groups, classes of different groups are compared if
their marks leave room for the similarity. A mark is a bitmap of a set's
shingles; a bit that only one of two marks has stands for a shingle that they
don't share. No link is lost for the groups, however many texts meet.

Defined results: texts of fewer than five words are one shingle; null and
empty texts, and texts of white space, are copies of each other. Ids that are
null come last. Rows that share id and text count as one, and ties fall to the
smaller id. Very long texts are processed whole. Other columns pass through. An
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.llm.common import arrow_udf, bounded_broadcast, col, cut_lineage
from strataquery.llm.simhash import STRIDE, components, keep_first, shared

WORDS_IN = 5
LEAST = 0.8
SEGMENTS, WIDTH = 4, 32
#: Longs of a mark.
MARK = 16


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # both touch ASCII only


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of the runs of five words, sorted."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest, space = xxhash.xxh64_intdigest, b" ".join
    if len(words) < WORDS_IN:
        return np.array([digest(space(words), 42)], dtype=np.uint64)
    total, parts = len(words) - WORDS_IN + 1, []
    for start in range(0, total, STRIDE):
        part = words[start : min(start + STRIDE, total) + WORDS_IN - 1]
        parts.append(np.unique(np.array([digest(space(x), 42) for x in zip(*[part[i:] for i in range(WORDS_IN)])], dtype=np.uint64)))
    return np.unique(np.concatenate(parts))


def marked_shingles(words: list[bytes]) -> np.ndarray:
    """The mark and the hashes of ``shingles``, as signed longs."""
    hashes = shingles(words)
    bits = np.zeros(64 * MARK, np.uint8)
    bits[(hashes % np.uint64(64 * MARK)).astype(np.int64)] = 1
    return np.concatenate([np.packbits(bits).view(np.int64), hashes.view(np.int64)])


def word_print(words: list[bytes]) -> list[int]:
    """SimHash of the distinct words, as segments: a bit is 1 if set in over half of the words' hashes."""
    distinct = list(set(words))
    ones = np.zeros(SEGMENTS * WIDTH, dtype=np.int64)
    for start in range(0, len(distinct), STRIDE):
        octets = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct[start : start + STRIDE])), np.uint8).reshape(-1, SEGMENTS * WIDTH // 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(distinct)).view(">u4").tolist()


def sketch(text: str | None) -> list[int]:
    """Hash of the words, their number, and the fingerprint's segments."""
    words = _words(text)
    key = xxhash.xxh64_intdigest(b" ".join(words), 7)
    return [key - (1 << 64) if key >> 63 else key, len(words), *word_print(words)]


def _longs(text: Column, of) -> Column:
    @arrow_udf("array<bigint>")
    def mark(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([of(x) for x in part.to_pylist()], type=pa.list_(pa.int64()))

    return mark(text)


def variants(fp: Column) -> Column:
    """Longs that name a segment, the bit struck out of it and its other bits."""
    whole = (1 << WIDTH) - 1
    return F.array(*[F.get(fp, F.lit(s)).bitwiseAND(F.lit(whole & ~(1 << b))) + F.lit((s * WIDTH + b) << WIDTH) for s in range(SEGMENTS) for b in range(WIDTH)])


def _members(classes: DataFrame) -> DataFrame:
    """(variant, key) of each variant that two classes or more share, and of few others."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # each row becomes 128: the number of tasks is set, as rows this narrow would be dealt to few
    return shared(classes.repartition(parts, "key").select(F.explode(variants(F.col("fp"))).alias("variant"), "key"))


def _sets(df: DataFrame, text: str, doc_id: str, classes: DataFrame, members: DataFrame) -> DataFrame:
    """key, the set of shingles (s), its size and its mark (b0, b1 and so on). Only texts that meet others are read again, one of each class."""
    wanted = cut_lineage(classes.join(members.select("key").distinct(), "key", "left_semi").select("key", "first", "repeated"))
    rows = df.select(col(doc_id).alias("id"), F.xxhash64(col(text)).alias("hash"), col(text).alias("body"))
    named = bounded_broadcast(wanted.select("key", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash")))
    texts = rows.join(named, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))).select("key", "body")
    sets = texts.select("key", _longs(F.col("body"), lambda x: marked_shingles(_words(x))).alias("m"))
    if not wanted.where("repeated").isEmpty():  # rows with the same id and text
        sets = sets.dropDuplicates(["key"])
    return cut_lineage(sets.select("key", F.slice("m", MARK + 1, F.size("m")).alias("s"), (F.size("m") - MARK).alias("size"), *[F.get("m", F.lit(i)).alias(f"b{i}") for i in range(MARK)]))


FACTS = ("size", *[f"b{i}" for i in range(MARK)])


def _facts(sets: DataFrame, as_: str) -> DataFrame:
    return sets.select(F.col("key").alias(as_), *[F.col(c).alias(f"{as_}_{c}") for c in FACTS])


def _room(a: str, b: str) -> Column:
    """Whether two sets may be similar: an overlap is what one mark doesn't have alone at most, and has to be ``LEAST / (1 + LEAST)`` of both sizes."""

    def shared(x: str, y: str) -> Column:
        alone = F.lit(0)
        for i in range(MARK):
            alone = alone + F.bit_count(F.col(f"{x}_b{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}_b{i}"))))
        return F.col(f"{x}_size") - alone

    sizes = F.col(f"{a}_size") + F.col(f"{b}_size")
    return F.least(shared(a, b), shared(b, a)) >= F.lit(LEAST / (1 + LEAST)) * sizes


def _pivots(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, pivot) of all variants, with the bits in which they differ and how many the pivot meets."""
    crowds = members.groupBy("variant").agg(F.count(F.lit(1)).alias("n"))
    met = members.join(crowds, "variant").groupBy("key").agg(F.sum("n").alias("met"))
    first = members.join(met, "key").groupBy("variant").agg(F.max(F.struct("met", "key")).alias("top"))
    own = members.join(first.select("variant", "top"), "variant").where("key != top.key").select("key", F.col("top.key").alias("pivot"), F.col("top.met").alias("met")).distinct()
    prints = classes.select("key", "fp")
    both = own.join(prints, "key").join(prints.select(F.col("key").alias("pivot"), F.col("fp").alias("fq")), "pivot")
    apart = F.aggregate(F.zip_with("fp", "fq", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return both.select("key", "pivot", "met", apart.alias("apart"))


def _first_pairs(pivots: DataFrame) -> DataFrame:
    """Each key with its nearest pivot and with its best connected one."""
    best = pivots.groupBy("key").agg(F.min(F.struct("apart", "pivot")).alias("near"), F.max(F.struct("met", "pivot")).alias("top"))
    return _ordered(best.select(F.col("key").alias("x"), F.explode(F.array("near.pivot", "top.pivot")).alias("y")))


def _open(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) in different groups."""
    for one in ("a", "b"):
        named = roots.select(F.col("node").alias(one), F.col("root").alias(f"root_{one}"))
        pairs = pairs.join(named, one, "left").withColumn(f"root_{one}", F.coalesce(f"root_{one}", one))
    return pairs.where("root_a != root_b").select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of ``pairs`` that are similar, by their whole sets; sets travel only for pairs whose marks leave room."""
    pairs = cut_lineage(pairs.join(_facts(sets, "a"), "a").join(_facts(sets, "b"), "b").where(_room("a", "b")).select("a", "b"))
    named = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    sets = sets.join(bounded_broadcast(cut_lineage(named)), "key", "left_semi")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return cut_lineage(shared.where(F.col("i") >= F.lit(LEAST) * (F.col("n") - F.col("i"))).select("a", "b"))


def _rest(members: DataFrame, sets: DataFrame, roots: DataFrame, tested: DataFrame) -> DataFrame:
    """Untested pairs under one variant that are in different groups and may be similar."""
    grouped = members.join(roots.withColumnRenamed("node", "key"), "key", "left").select("variant", "key", F.coalesce("root", "key").alias("root"))
    mixed = grouped.groupBy("variant").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("variant")
    rows = cut_lineage(grouped.join(bounded_broadcast(cut_lineage(mixed)), "variant", "left_semi"))
    one, two = (rows.select("variant", F.col("key").alias(k), F.col("root").alias(f"root_{k}")).join(_facts(sets, k), k) for k in "ab")
    pairs = one.join(two, "variant").where((F.col("root_a") < F.col("root_b")) & _room("a", "b"))
    return _ordered(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))).join(tested, ["a", "b"], "left_anti")


def keep_one(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of ``df`` for each group of near copies: the row with the group's smallest id."""
    marks = df.select(col(doc_id).alias("doc_id"), F.xxhash64(col(text)).alias("text_hash"), _longs(col(text), sketch).alias("s"))
    marked = cut_lineage(marks.select("doc_id", "text_hash", F.col("s")[0].alias("node"), F.col("s")[1].alias("n"), F.slice("s", 3, SEGMENTS).alias("fp")))
    rows = marked.where(F.col("n") >= WORDS_IN).groupBy(F.col("node").alias("key"), "doc_id", "text_hash").agg(F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct("doc_id", "text_hash", F.col("n").alias("n"))).alias("first")
    classes = cut_lineage(rows.groupBy("key").agg(F.min("fp").alias("fp"), first).withColumn("repeated", F.col("first.n") > 1))
    members = _members(classes)
    sets = _sets(df, text, doc_id, classes, members)
    pivots = cut_lineage(_pivots(members, classes))
    tested = cut_lineage(_first_pairs(pivots))
    links = _linked(tested, sets)
    roots = components(links)
    others = _open(_ordered(pivots.select(F.col("key").alias("x"), F.col("pivot").alias("y"))).join(tested, ["a", "b"], "left_anti"), roots)
    for more in (lambda: others, lambda: _rest(members, sets, roots, tested)):
        new = cut_lineage(more())
        found = _linked(new, sets)
        tested = cut_lineage(tested.unionByName(new))
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = components(links)
    return keep_first(df, marked.join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root")), text, doc_id)
