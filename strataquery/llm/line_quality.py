"""Quality rules by cross-document line frequency (operator 4).

Lines are normalised (words joined by one space, lower case) and hashed. For
each host the distinct documents with a line are counted. A line is common if
more than ``LEAST_DOCUMENTS`` of a host's documents have it; a share of the
host's documents may be asked for besides. The limit doesn't grow with the
host, so boilerplate of a large host is found like that of a small one. Common
lines are removed, and a document is depleted if fewer than ``LEFT`` of its
words remain.

What counts is an option: ``per="texts"``, the default, takes copies of one
text as one document, so that a group of copies doesn't condemn itself and
deduplication can keep one; ``per="documents"`` counts each row.

Base rules reject texts with fewer than 20 words or with over 30% of their
words in 8-word windows that occur twice or more in the text.

Only built-in expressions are used. Counting runs over 64-bit hashes of lines
and 128 bits of the text; whole texts are never shuffled.

Defined results: a null text counts as empty, has no words and fails the base
rules. A null host is a host of its own. Equal rows get equal results. Lines
without a word count for nothing. Very long texts are processed whole. Other
columns pass through; a result takes the place of a column of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.llm.common import SPACE, WORD, col, cut_lineage, field, let, packed, unpacked

LEAST_DOCUMENTS = 20
SHARE = 0.0
LEFT = 0.3
WINDOW = 8
#: Most common lines, and most hosts that have some, that are broadcast: 8 bytes a line and a name a host.
BROADCAST_LINES, BROADCAST_HOSTS = 500_000, 20_000
#: Common lines of a host that one lookup walks over.
SLOT = 8


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]++"), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more.

    Windows are compared by 64-bit hashes. Without two equal hashes, which is
    the rule, the answer is 0 after one pass. Otherwise (hash, position) pairs
    are sorted, positions next to an equal hash are kept, and the union of
    their windows is measured; n log n in the words.
    """
    windows = F.when(F.size(words) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            def twin(x: Column, i: Column) -> Column:
                left = (i > 0) & (F.get(s, i - 1)["h"] == x["h"])
                right = (i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == x["h"])
                return F.when(left | right, x["i"])

            return F.array_sort(F.array_compact(F.transform(s, twin)))

        def union(at: Column) -> Column:
            gaps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return let(let(pairs, repeats), union)

    return F.coalesce(let(windows, lambda hashes: F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"))


def _counted(body: Column) -> Column:
    """Struct of the words (n) and of those in repeated windows (r)."""
    return let(_words(body), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("r")))


def _failed(c: Column) -> Column:
    return (c["n"] < 20) | (100 * c["r"] > 30 * c["n"])


def base_facts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of a whole text."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    return let(
        _counted(body),
        lambda c: F.struct(
            c["n"].alias("n_words"),
            F.length(F.regexp_replace(body, SPACE, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(body, r"[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            c["r"].alias("n_repeat_words"),
            _failed(c).alias("base_failed"),
        ),
    )


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def distinct_lines(text: Column) -> Column:
    """Structs (line, words): hash of each distinct normalised line and the words in all its places.

    The hashes are sorted, and the end of each run of equal ones tells how often they occur.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normal_line), lambda x: x != "")
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" ")))
    hashed = F.array_sort(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), (spaces(x) + 1).cast("long").alias("words"))))

    def runs(s: Column) -> Column:
        last = F.size(s) - 1
        ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.get(s, i)["line"] != F.get(s, i + 1)["line"]))
        first = lambda e, k: F.when(k == 0, F.lit(-1)).otherwise(F.get(e, k - 1))
        counted = let(ends, lambda e: F.transform(e, lambda p, k: F.struct(F.get(s, p)["line"].alias("line"), (F.get(s, p)["words"] * (p - first(e, k))).alias("words"))))
        return F.when(last >= 0, counted)

    return let(hashed, runs)


def _text_key(text: Column) -> list[Column]:
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(7), body).alias("t2")]


def text_lines(df: DataFrame, *, text: str = "text", host: str = "source") -> DataFrame:
    """host, t1, t2, line hash, words (over all its places) and documents of each distinct line of each distinct text.

    Map-side aggregation folds copies of a text before the shuffle.
    """
    rows = df.select(col(host).alias("host"), *_text_key(col(text)), F.explode(distinct_lines(col(text))).alias("of")).select("host", "t1", "t2", "of.line", "of.words")
    return cut_lineage(rows.groupBy("host", "t1", "t2", "line").agg(F.max("words").alias("words"), F.count(F.lit(1)).alias("documents")))


def common_lines(rows: DataFrame, least: int = LEAST_DOCUMENTS, share: float = SHARE, per: str = "texts") -> DataFrame:
    """h and l: host and hash of the lines of ``text_lines`` above the limits."""
    if per not in ("texts", "documents"):
        raise ValueError("per must be texts or documents")
    number = F.count(F.lit(1)) if per == "texts" else F.sum("documents")
    common = rows.groupBy("host", "line").agg(number.alias("n")).where(F.col("n") > least)
    if share > 0:
        one = F.lit(1) if per == "texts" else F.max("documents")
        hosts = rows.groupBy("host", "t1", "t2").agg(one.alias("x")).groupBy("host").agg(F.sum("x").alias("all")).withColumnRenamed("host", "h")
        common = common.join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > share * F.col("all"))
    return common.select(F.col("host").alias("h"), F.col("line").alias("l"))


def common_parts(rows: DataFrame, common: DataFrame) -> DataFrame:
    """host, t1, t2, the common lines (array of hashes, at most the text's own) and the words in them, of each distinct text that has any."""
    found = rows.join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
    return found.groupBy("host", "t1", "t2").agg(F.sum("words").alias("removed"), F.collect_set("line").alias("common"))


def _slots(common: DataFrame) -> DataFrame | None:
    """h and its common lines dealt by hash to arrays of about ``SLOT``; None if there are too many to broadcast."""
    lines, hosts = common.agg(F.count(F.lit(1)), F.count_distinct(F.coalesce("h", F.lit("")))).first()
    if lines > BROADCAST_LINES or hosts > BROADCAST_HOSTS:
        return None
    sizes = common.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / SLOT).cast("int").alias("slots")).withColumnRenamed("h", "g")
    dealt = common.join(sizes, F.col("h").eqNullSafe(F.col("g"))).groupBy("h", "slots", F.pmod("l", "slots").cast("int").alias("slot")).agg(F.collect_list("l").alias("own"))
    filled = dealt.groupBy("h", "slots").agg(F.map_from_entries(F.collect_list(F.struct("slot", "own"))).alias("by"))
    none = F.array().cast("array<bigint>")
    return filled.select("h", F.transform(F.sequence(F.lit(0), F.col("slots") - 1), lambda i: F.coalesce(F.try_element_at("by", i), none)).alias("slots"))


def _is_common(line: Column) -> Column:
    return F.array_contains(F.get("slots", F.pmod(line, F.size("slots")).cast("int")), line)


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def _key_of(host: Column, text: Column) -> list[Column]:
    t1, t2 = _text_key(text)
    return [host.alias("k_host"), t1.alias("k_t1"), t2.alias("k_t2")]


def _same_key() -> Column:
    return F.col("k_host").eqNullSafe(F.col("host")) & (F.col("k_t1") == F.col("t1")) & (F.col("k_t2") == F.col("t2"))


def _found(df: DataFrame, text: str, host: str, least: int, share: float, per: str) -> tuple[DataFrame, DataFrame]:
    rows = text_lines(df, text=text, host=host)
    return rows, cut_lineage(common_lines(rows, least, share, per))


def judge(df: DataFrame, *, text: str = "text", host: str = "source", left: float = LEFT, least: int = LEAST_DOCUMENTS, share: float = SHARE, per: str = "texts") -> DataFrame:
    """``df`` without ``text`` and with the base facts, removed_words and kept; texts stay where they are read."""
    names = [c for c in df.columns if c != text]
    facts = df.select(F.struct(*[col(c) for c in names]).alias("row"), base_facts(col(text)).alias("facts"), *_key_of(col(host), col(text)))
    out = facts.join(common_parts(*_found(df, text, host, least, share, per)).drop("common"), _same_key(), "left")
    gone, words = F.coalesce("removed", F.lit(0)).cast("long"), F.col("facts.n_words")
    kept = ~F.col("facts.base_failed") & ~(words - gone < left * words)
    return out.select(*unpacked(names, RESULTS), "facts.*", gone.alias("removed_words"), kept.alias("kept"))


def _without(text: Column, is_common) -> Column:
    """The text without the lines that ``is_common`` tells by their hash."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~is_common(F.xxhash64(normal_line(x)))), "\n")


def _stripped(df: DataFrame, text: str, host: str, left: float | None, least: int, share: float, per: str) -> DataFrame:
    """``df`` without common lines; with ``left``, without the documents that fail or are depleted.

    Common lines are looked up in a broadcast table of each host's. Where they
    are too many for that, each text is joined with its own, by a shuffle.
    """
    rows, common = _found(df, text, host, least, share, per)
    body = field(text)
    # -1 for texts that fail; one condition over both sides of the join, so that no filter below it counts a text again
    words = F.lit(0) if left is None else F.coalesce(let(_counted(F.coalesce(body, F.lit(""))), lambda c: F.when(_failed(c), -1).otherwise(c["n"])), F.lit(-1))
    facts = packed(df).select("row", words.cast("long").alias("n"), *_key_of(field(host), body))
    if (slots := _slots(common)) is not None:
        joined = facts.join(F.broadcast(slots), F.col("k_host").eqNullSafe(F.col("h")), "left")
        touched = F.col("slots").isNotNull() & F.exists(distinct_lines(body), lambda x: _is_common(x["line"]))
        rest = F.when(F.coalesce(touched, F.lit(False)), _without(body, _is_common)).otherwise(body)
        removed = F.when(F.col("slots").isNotNull() & (F.col("n") > 0), F.aggregate(F.filter(distinct_lines(body), lambda x: _is_common(x["line"])), F.lit(0).cast("long"), lambda a, x: a + x["words"]))
    else:
        joined = facts.join(common_parts(rows, common), _same_key(), "left")
        rest = F.when(F.col("common").isNull(), body).otherwise(_without(body, lambda h: F.array_contains("common", h)))
        removed = F.col("removed")
    if left is not None:
        joined = joined.where(F.col("n") - F.coalesce(removed, F.lit(0)) >= left * F.col("n"))
    return joined.select(*[rest.alias(c) if c == text else field(c).alias(c) for c in df.columns])


def clean(df: DataFrame, *, text: str = "text", host: str = "source", left: float = LEFT, least: int = LEAST_DOCUMENTS, share: float = SHARE, per: str = "texts") -> DataFrame:
    """Documents of ``df`` that are kept, with their columns; the common lines are taken out of their texts. Both verdicts are about the whole text."""
    return _stripped(df, text, host, left, least, share, per)


def strip_common_lines(df: DataFrame, *, text: str = "text", host: str = "source", least: int = LEAST_DOCUMENTS, share: float = SHARE, per: str = "texts") -> DataFrame:
    """``df`` with the common lines taken out of ``text``; a null text stays null."""
    return _stripped(df, text, host, None, least, share, per)
