"""URL filters by rules and link-graph propagation (operator 9).

A URL's host and path are matched against rules first. Hosts without a rule
for the URL get the method's verdict: trust flows from hosts of allowed pages
along links, distrust flows from hosts of blocked pages against links, both as
personalised PageRank over the weighted host graph. A host is blocked if the
distrust that reached it is more than the trust it holds, and more than
``THRESHOLD`` of an even share. The distrust that a seed holds by being a seed
doesn't count against the rest of the host: its rule already judges the paths
it covers. A host that no link reaches is allowed.

Links are the absolute and protocol-relative addresses in href and src
attributes of the page, between different hosts; a link counts once for each
page that has it. All sums are of whole numbers (the mass is ``MASS`` grains),
so the order of additions doesn't matter and reruns agree. Steps go on until
what is still to move is less than ``SETTLED`` of an even share, so hosts any
number of links away are reached. Only built-in expressions are used; the
graph's rows are host pairs.

Rules are a driver-side list, so a bounded parameter. A rule fits its host and
all its subdomains if the path starts with the rule's; the longest fitting
rule wins, by characters, then by code points.

Defined results: a null URL or one without ``://`` has empty host and path and
is allowed unless a rule says otherwise; null html has no links. Repeated rows
get equal verdicts and each counts as a page. Very long URLs and pages are read
whole. An empty table gives none. Other columns pass through, whatever their
names; a result takes the place of a column of its name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.llm.common import col, cut_lineage, lower_ascii, unpacked

Rule = tuple[str, str]  # ("allow" or "block", host and path as in "example.com/en/")

MASS = 1 << 40
FOLLOW = 0.85
THRESHOLD = 1.0
SETTLED = 0.001

RESULTS = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The rule that wins and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last that fits wins
        if word not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks, not {word!r}")
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """a, b and the number of pages of host a that link to host b."""
    found = F.regexp_extract_all(col(html), F.lit(r"(?i)(?:href|src)\s*+=\s*+[\"']?+(?:https?:)?+//([^/?#\"'\s<>]++)"), F.lit(1))
    linked = pages.select(host_of(col(url)).alias("a"), F.explode(F.array_distinct(F.transform(found, lower_ascii))).alias("b"))
    return linked.where("a != b and a != ''").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, steps: int | None = None, follow: float = FOLLOW, within: float = 1.0) -> DataFrame:
    """host, the grains that reached it over edges (a, b, n) from seeds (host, n), and its mass in all.

    Personalised PageRank: of a host's mass the share ``follow`` goes on along
    its edges by weight, the rest and what rounding or dead ends lose returns
    to the seeds; that returned mass is only in the last column.

    Without ``steps`` it goes on until all hosts together are less than
    ``within`` grains from the limit, but for rounding. A step shrinks the
    distance from the limit to ``follow`` of it or less, which also bounds the
    number of steps. One aggregate a step reaches the driver.
    """
    out = edges.groupBy("a").agg(F.sum("n").alias("all"))
    steps_of = cut_lineage(edges.join(out, "a").select("a", "b", (F.col("n") / F.col("all")).alias("share")))
    total = seeds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total or steps_of.isEmpty():
        return seeds.select("host", F.lit(0.0).alias("reached"), F.lit(0.0).alias("mass")).limit(0)
    start = cut_lineage(seeds.select("host", F.floor(F.lit(float(MASS)) * F.col("n") / F.lit(float(total))).cast("double").alias("seed")))
    mass = start.select("host", F.col("seed").alias("mass"))
    reached = start.select("host", F.lit(0.0).alias("reached")).limit(0)
    most = steps if steps is not None else max(1, math.ceil(math.log(within / (2 * MASS)) / math.log(follow)))
    for _ in range(most):
        moved = steps_of.join(mass, F.col("a") == F.col("host")).groupBy("b").agg(F.sum(F.floor(F.col("mass") * F.col("share") * F.lit(follow)).cast("double")).alias("reached"))
        both = moved.select(F.col("b").alias("host"), "reached", F.lit(0.0).alias("was")).unionByName(reached.select("host", F.lit(0.0).alias("reached"), F.col("reached").alias("was")))
        now = cut_lineage(both.groupBy("host").agg(F.sum("reached").alias("reached"), F.sum("was").alias("was")))
        held, change = now.agg(F.coalesce(F.sum("reached"), F.lit(0.0)), F.coalesce(F.sum(F.abs(F.col("reached") - F.col("was"))), F.lit(0.0))).first()
        reached = now.select("host", "reached")
        back = (MASS - held) / MASS
        seeded = start.select("host", F.floor(F.col("seed") * F.lit(back)).cast("double").alias("mass"))
        both = seeded.withColumn("reached", F.lit(0.0)).unionByName(reached.withColumn("mass", F.col("reached")))
        mass = both.groupBy("host").agg(F.sum("mass").alias("mass"), F.sum("reached").alias("reached"))
        # the mass changed by twice this at most: once where it reached, once in what returns
        if steps is None and 2 * change * follow / (1 - follow) <= within:
            break
    return mass.where("reached > 0 or mass > 0")


def host_verdicts(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url", html: str = "html", steps: int | None = None, threshold: float = THRESHOLD, edges: DataFrame | None = None) -> DataFrame:
    """host, trust and distrust for each host that the method blocks."""
    host, path = host_of(col(url)), path_of(col(url))
    known = pages.select(host.alias("host"), rule_of(host, path, rules)[1].alias("verdict")).groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    known = cut_lineage(known.where("host != ''"))
    edges = cut_lineage(host_edges(pages, url, html) if edges is None else edges)
    even = MASS / max(1, known.count())
    within = SETTLED * even
    trust = propagate(edges, known.where("good > 0").select("host", F.col("good").alias("n")), steps, within=within).select("host", F.col("mass").alias("trust"))
    against = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    distrust = propagate(against, known.where("bad > 0").select("host", F.col("bad").alias("n")), steps, within=within).select("host", F.col("reached").alias("distrust"))
    judged = distrust.join(trust, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), "distrust")
    return judged.where((F.col("distrust") > F.col("trust")) & (F.col("distrust") > F.lit(threshold * even)))


def judge(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url", html: str = "html", **options) -> DataFrame:
    """``pages`` without html and with host, path, rule and verdict."""
    names = [c for c in pages.columns if c != html]
    blocked = host_verdicts(pages, rules, url=url, html=html, **options).select(F.col("host").alias("blocked"))
    rows = pages.select(F.struct(*[col(c) for c in names]).alias("row"), host_of(col(url)).alias("host"), path_of(col(url)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    spread = F.when(F.col("blocked").isNotNull(), "block").otherwise("allow")
    judged = rows.join(blocked, F.col("host") == F.col("blocked"), "left")
    return judged.select(*unpacked(names, RESULTS), "host", "path", rule.alias("rule"), F.coalesce(verdict, spread).alias("verdict"))
