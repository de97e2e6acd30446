"""Queries of scopes, graphs, intervals, references and refactorings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.operators import graphs, references, windows
from strataquery.plans.base import Tables, query


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def binding_semijoin(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


# Hosts are scopes read from the right: www.a.example.com lies in com.example.a.
_SCOPE = "array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')), '.')"


def _scopes(t: Tables) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    language = F.regexp_extract("url", r"/(en|de|fr|es)/", 1)
    return t.pages.select("page_id", F.array_join(F.reverse(F.split(host, r"\.")), ".").alias("scope"), language.alias("name"), F.startswith("url", F.lit("https")).alias("secure"))


@query(rf"""
WITH p AS (SELECT page_id, {_SCOPE} AS scope, regexp_extract(url, '/(en|de|fr|es)/', 1) AS name, starts_with(url, 'https') AS secure FROM pages),
d AS (SELECT DISTINCT name, s AS scope FROM (SELECT name, unnest([scope, regexp_replace(scope, '\.[^.]*$', ''), regexp_extract(scope, '^[^.]*')]) AS s FROM p WHERE secure)),
m AS (SELECT p.page_id, d.scope, len(string_split(d.scope, '.')) AS depth FROM p JOIN d ON p.name = d.name AND (p.scope = d.scope OR starts_with(p.scope, d.scope || '.')))
SELECT page_id AS use_id, arg_max(scope, depth) AS declaration_id, CAST(max(depth) AS BIGINT) AS depth FROM m GROUP BY page_id""")
def nearest_scope(t: Tables) -> DataFrame:
    uses = _scopes(t)
    declared = uses.where("secure").select("name", F.explode(F.array("scope", F.regexp_replace("scope", r"\.[^.]*$", ""), F.regexp_extract("scope", r"^[^.]*", 0))).alias("scope")).distinct()
    found = graphs.nearest_scope(uses.select(F.col("page_id").alias("use_id"), F.lit("f").alias("file"), "name", "scope"), declared.select(F.lit("f").alias("file"), "name", "scope", F.col("scope").alias("declaration_id")))
    return found.withColumn("depth", F.col("depth").cast("long"))


@query("SELECT p_name, count(*) AS declarations, count(*) = 1 AS sole FROM part GROUP BY p_name")
def unique_name_probe(t: Tables) -> DataFrame:
    return t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("declarations")).withColumn("sole", F.col("declarations") == 1)


def _edges(t: Tables) -> DataFrame:
    """Each part points to the part with half its key."""
    return t.part.where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))


@query("""
WITH RECURSIVE r AS (
  SELECT p_partkey AS start, p_partkey // 2 AS node, 1 AS hops FROM part WHERE p_partkey > 0
  UNION ALL SELECT start, node // 2, hops + 1 FROM r WHERE node > 0 AND hops < 4)
SELECT start, node, CAST(min(hops) AS BIGINT) AS hops FROM r GROUP BY start, node""")
def reexport_chain(t: Tables) -> DataFrame:
    starts = t.part.where("p_partkey > 0").select(F.col("p_partkey").alias("start"))
    return graphs.reach(starts, _edges(t), 4).withColumn("hops", F.col("hops").cast("long"))


@query("""
WITH RECURSIVE r AS (
  SELECT p_partkey // 2 AS base, p_partkey AS sub FROM part WHERE p_partkey > 0 AND p_partkey // 2 IN (3, 50, 700)
  UNION ALL SELECT base, p_partkey FROM r JOIN part ON p_partkey // 2 = sub WHERE p_partkey > 0)
SELECT base, sub FROM r""")
def subclass_closure(t: Tables) -> DataFrame:
    starts = t.spark.createDataFrame([(3,), (50,), (700,)], "start long")
    below = graphs.closure(starts, _edges(t).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return below.select(F.col("start").alias("base"), F.col("node").alias("sub"))


@query("""
SELECT event_id, k AS positional_count, k > 90 AS has_positional_spread FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) JOIN (SELECT l_orderkey AS i, count(*) AS uses FROM lineitem GROUP BY l_orderkey) ON i = event_id""")
def call_shape_join(t: Tables) -> DataFrame:
    shape = F.to_json(F.struct(F.from_json("props", "k int")["k"].alias("positional_count"), (F.from_json("props", "k int")["k"] > 90).alias("has_positional_spread")))
    shapes = t.events.select("event_id", shape.alias("shape_json"))
    used = t.lineitem.select(F.col("l_orderkey").alias("event_id")).distinct()
    call = F.from_json("shape_json", references.CALL_SHAPE)
    return shapes.join(used, "event_id").select("event_id", call["positional_count"].alias("positional_count"), call["has_positional_spread"].alias("has_positional_spread"))


_SPANS = "(SELECT l_orderkey AS file, l_linenumber AS interval_id, date_diff('day', DATE '1990-01-01', l_shipdate) AS s, date_diff('day', DATE '1990-01-01', l_shipdate) + CAST(l_quantity AS INTEGER) AS e FROM lineitem)"


def _spans(t: Tables) -> DataFrame:
    """Lines of an order as spans of days: from shipping on, as many days as pieces."""
    first = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return t.lineitem.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("interval_id"), first.alias("start"), (first + F.col("l_quantity").cast("int")).alias("end"))


@query(f"""
WITH i AS {_SPANS}, p AS (SELECT o_orderkey AS file, o_orderkey AS point_id, median(s) AS mid FROM i JOIN orders ON o_orderkey = file GROUP BY o_orderkey)
SELECT point_id, CAST(arg_min(interval_id, (e - s) * 1000 + interval_id) AS BIGINT) AS interval_id, count(*) AS depth FROM p JOIN i USING (file) WHERE s <= mid AND mid <= e GROUP BY point_id""")
def interval_enclosing(t: Tables) -> DataFrame:
    spans = _spans(t)
    points = spans.join(t.orders.select(F.col("o_orderkey").alias("file")), "file").groupBy("file").agg(F.median("start").alias("at")).withColumn("point_id", F.col("file"))
    return graphs.innermost(points, spans, "file").withColumn("interval_id", F.col("interval_id").cast("long"))


@query(f"""
WITH i AS (SELECT file, s, max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {_SPANS})
SELECT DISTINCT file, CAST(b AS BIGINT) AS gap_start, CAST(s AS BIGINT) AS gap_end FROM i WHERE s > b""")
def interval_gaps(t: Tables) -> DataFrame:
    return graphs.gaps(_spans(t), "file", "start", "end").withColumns({c: F.col(c).cast("long") for c in ("gap_start", "gap_end")})


_ROOT = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '(/[^/]*|[?#].*)$', '')"


@query(rf"""
WITH r AS (SELECT DISTINCT root FROM (SELECT page_id, unnest([regexp_extract(url, '://([^/?#]*)', 1), regexp_extract(url, '://([^/?#]*/[^/?#]*)', 1)]) AS root FROM pages) WHERE root <> '')
SELECT a.root AS a, b.root AS b, CASE WHEN starts_with(b.root, a.root || '/') THEN 'contains' ELSE 'nested' END AS relation
FROM r a JOIN r b ON a.root < b.root AND (starts_with(b.root, a.root || '/') OR starts_with(a.root, b.root || '/'))""")
def overlap_pairs(t: Tables) -> DataFrame:
    both = t.pages.select(F.explode(F.array(F.regexp_extract("url", "://([^/?#]*)", 1), F.regexp_extract("url", "://([^/?#]*/[^/?#]*)", 1))).alias("root"))
    roots = both.where("root != ''").distinct()
    return graphs.overlapping_roots(roots.withColumn("id", F.col("root")))


@query("SELECT a.s_nationkey AS common, a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND a.s_name <> b.s_name")
def sibling_pairs(t: Tables) -> DataFrame:
    return graphs.siblings(t.supplier, "s_nationkey", "s_name", "s_suppkey")


_BUCKETS = "CASE WHEN l_returnflag = 'A' THEN 'must_change' WHEN l_returnflag = 'N' THEN 'likely_change' WHEN l_linestatus = 'O' THEN 'declaration' ELSE 'override' END"


@query(f"""
WITH e AS (SELECT l_orderkey AS path, CASE WHEN l_quantity > 45 THEN NULL ELSE CAST(l_quantity AS BIGINT) // 10 END AS start_byte, l_linenumber AS reference_id, {_BUCKETS} AS bucket, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY path, start_byte ORDER BY list_position(['must_change', 'declaration', 'override', 'likely_change'], bucket), reference_id, l_extendedprice) AS n FROM e)
SELECT path, start_byte, bucket FROM n WHERE start_byte IS NULL OR n = 1""")
def edit_span_dedupe(t: Tables) -> DataFrame:
    bucket = F.when(F.col("l_returnflag") == "A", "must_change").when(F.col("l_returnflag") == "N", "likely_change").when(F.col("l_linestatus") == "O", "declaration").otherwise("override")
    start = F.when(F.col("l_quantity") <= 45, F.expr("cast(l_quantity as bigint) div 10"))
    edits = t.lineitem.select(F.col("l_orderkey").alias("path"), start.alias("start_byte"), start.alias("end_byte"), F.col("l_linenumber").alias("reference_id"), bucket.alias("bucket"))
    return windows.dedupe_edits(edits).select("path", "start_byte", "bucket")


# Flags of a row decide each step of the ladder; lines of orders stand for uses.
_FLAGS = """
l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity < 3 AS wildcard, CASE l_linenumber WHEN 1 THEN 'self' WHEN 2 THEN 'other' END AS receiver, l_quantity > 25 AS owner, l_tax > CAST(0.04 AS DOUBLE) AS space,
l_discount < CAST(0.02 AS DOUBLE) AS direct, l_discount < CAST(0.04 AS DOUBLE) AS chain, l_discount < CAST(0.06 AS DOUBLE) AS known, l_suppkey % 3 = 0 AS same_file, l_partkey % 2 AS declarations"""


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN wildcard THEN 'wildcard_import' WHEN receiver = 'self' AND owner THEN 'known_owner_member' WHEN receiver IS NOT NULL AND space THEN 'known_namespace_member' WHEN receiver IS NOT NULL THEN 'unknown_receiver'
  WHEN direct THEN 'direct_import_alias' WHEN chain THEN 'reexport_chain' WHEN known THEN 'unproven_reexport' WHEN same_file THEN 'same_file_symbol' WHEN declarations = 1 THEN 'name_only_candidate' ELSE 'ambiguous_symbol' END AS reason,
  CASE WHEN wildcard THEN 'unresolved' WHEN receiver IS NOT NULL THEN CASE WHEN (receiver = 'self' AND owner) OR space THEN 'exact' ELSE 'likely' END WHEN direct OR chain THEN 'exact' WHEN known THEN 'likely' WHEN same_file THEN 'exact' WHEN declarations = 1 THEN 'likely' ELSE 'unresolved' END AS resolution
FROM (SELECT *, {_FLAGS} FROM lineitem)""")
def resolution_ladder(t: Tables) -> DataFrame:
    receiver = F.when(F.col("l_linenumber") == 1, "self").when(F.col("l_linenumber") == 2, "other")
    step = references.ladder(
        wildcard=(F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") < 3), receiver=receiver, self_receiver=F.coalesce(receiver == "self", F.lit(False)), same_owner=F.col("l_quantity") > 25, receiver_targets=F.col("l_tax") > 0.04,
        direct=F.col("l_discount") < 0.02, chain=F.col("l_discount") < 0.04, module_known=F.col("l_discount") < 0.06, same_file=F.col("l_suppkey") % 3 == 0, declarations=F.col("l_partkey") % 2,
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", step.alias("s")).select("l_orderkey", "l_linenumber", "l_partkey", "s.resolution", "s.reason")


_RESOLUTION = "CASE o_orderstatus WHEN 'F' THEN 'exact' WHEN 'O' THEN 'likely' ELSE 'unresolved' END"


def _resolution() -> Column:
    return F.when(F.col("o_orderstatus") == "F", "exact").when(F.col("o_orderstatus") == "O", "likely").otherwise("unresolved")


@query(f"SELECT o_orderkey, CASE {_RESOLUTION} WHEN 'unresolved' THEN 'review' WHEN 'likely' THEN 'likely_change' ELSE CASE WHEN o_orderpriority = '5-LOW' OR o_custkey % 4 = 0 THEN 'must_change' ELSE 'evidence' END END AS bucket FROM orders")
def refactor_buckets(t: Tables) -> DataFrame:
    written = F.when(F.col("o_orderpriority") == "5-LOW", "a.b.name").otherwise("a.b.alias")
    kind = F.when(F.col("o_custkey") % 4 == 0, "import").otherwise("call")
    return t.orders.select("o_orderkey", references.rename_bucket(_resolution(), written, kind, "name").alias("bucket"))


@query(f"SELECT bucket, count(*) AS findings FROM (SELECT CASE {_RESOLUTION} WHEN 'unresolved' THEN 'review' WHEN 'likely' THEN 'likely_change' ELSE 'evidence' END AS bucket FROM orders) GROUP BY bucket")
def bucket_counts(t: Tables) -> DataFrame:
    return references.bucket_counts(t.orders.select(references.rename_bucket(_resolution(), F.lit("x"), F.lit("call"), "name").alias("bucket")))


@query("SELECT source, CASE WHEN bool_or(toxic IS NULL AND lang = 'es') THEN 'incomplete' WHEN coalesce(bool_or(quality = 0), false) THEN 'complete_with_dynamic_limitations' ELSE 'complete' END AS state FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def completeness(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id", "left").groupBy("source").agg(F.bool_or(F.col("toxic").isNull() & (F.col("lang") == "es")).alias("gap"), F.coalesce(F.bool_or(F.col("quality") == 0), F.lit(False)).alias("unsure"))
    return rows.select("source", references.completeness(F.col("gap"), F.col("unsure")).alias("state"))


# Old signature f(a, b, c); new one f(a, c, *, b=…). Calls pass l_linenumber positionals and perhaps the keyword b.
@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0.07::DOUBLE THEN 'spread_uncertainty' WHEN l_returnflag <> 'A' THEN 'missing_required_parameter' WHEN l_linestatus = 'O' THEN 'invalid_keyword' WHEN l_linenumber < 2 THEN 'missing_required_parameter'
  WHEN l_linenumber > 3 THEN 'removed_positional_parameter' WHEN l_linenumber = 3 THEN 'removed_positional_parameter' ELSE 'positional_order_change' END AS issue FROM lineitem""")
def signature_issues(t: Tables) -> DataFrame:
    def parameters(*items: tuple[str, str, bool]) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(r).alias("required"), F.lit(i).alias("position"), F.lit(False).alias("destructured")) for i, (n, k, r) in enumerate(items)])

    old = parameters(("a", "positional", True), ("b", "positional", True), ("c", "positional", True))
    new = parameters(("a", "positional", True), ("c", "positional", True), ("flag", "keyword_only", True))
    keywords = F.array_compact(F.array(F.when(F.col("l_returnflag") == "A", "flag"), F.when(F.col("l_linestatus") == "O", "gone")))
    call = F.struct(F.col("l_linenumber").alias("positional_count"), keywords.alias("keywords"), (F.col("l_tax") > 0.07).alias("has_positional_spread"), F.lit(False).alias("has_keyword_spread"))
    issue = references.signature_issue(call, old, new, overloads=F.lit(1), bound=F.lit(False))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", issue.alias("issue"))
