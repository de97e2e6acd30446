"""Queries of change detection, mutations, history, statistics and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.operators import changes, graphs, metrics, mutations, paging, stats, windows
from strataquery.plans.base import Tables, query

# Orders play a project's files. The scan finds them again, but files of status P have moved to another path,
# urgent ones have other content, and of the rest those of status F only another time.
_SNAPSHOTS = """
stored AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_custkey AS size, epoch_us(o_orderdate) * 1000 AS mtime_ns, sha256(o_orderpriority || o_orderkey) AS content_hash FROM orders),
scanned AS (
  SELECT CASE WHEN o_orderstatus = 'P' THEN 'moved/' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS path,
         CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey + 1 ELSE o_custkey END AS size,
         epoch_us(o_orderdate) * 1000 + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS mtime_ns,
         sha256(CASE WHEN o_orderpriority = '1-URGENT' THEN 'changed' ELSE o_orderpriority END || o_orderkey) AS content_hash FROM orders)"""


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    orders = t.orders
    key, urgent = F.col("o_orderkey").cast("string"), F.col("o_orderpriority") == "1-URGENT"
    nanos = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000
    hashed = lambda text: F.sha2(F.concat(text, key).cast("binary"), 256)
    stored = orders.select(key.alias("path"), F.col("o_custkey").alias("size"), nanos.alias("mtime_ns"), hashed(F.col("o_orderpriority")).alias("content_hash"))
    scanned = orders.select(
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("moved/"), key)).otherwise(key).alias("path"),
        F.when(urgent, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("size"),
        (nanos + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("mtime_ns"),
        hashed(F.when(urgent, "changed").otherwise(F.col("o_orderpriority"))).alias("content_hash"),
    )
    return stored, scanned


@query(f"""WITH {_SNAPSHOTS}
SELECT path, CASE WHEN s.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN s.size = c.size AND s.mtime_ns = c.mtime_ns THEN 'unchanged' WHEN s.content_hash = c.content_hash THEN 'metadata_only' ELSE 'changed' END AS change
FROM stored s FULL JOIN scanned c USING (path)""")
def cdc_classify(t: Tables) -> DataFrame:
    return changes.classify_changes(*_snapshots(t))


@query(f"WITH {_SNAPSHOTS} SELECT path, content_hash FROM stored WHERE path NOT IN (SELECT path FROM scanned)")
def cdc_removed(t: Tables) -> DataFrame:
    return changes.removed(*_snapshots(t)).select("path", "content_hash")


@query(f"""WITH {_SNAPSHOTS}
SELECT bool_or(d) AS stale, count(*) FILTER (WHERE d) AS differences FROM (
  SELECT s.path IS NULL OR c.path IS NULL OR s.size IS DISTINCT FROM c.size OR s.mtime_ns IS DISTINCT FROM c.mtime_ns AS d FROM stored s FULL JOIN scanned c USING (path))""")
def staleness_flag(t: Tables) -> DataFrame:
    return changes.is_stale(*_snapshots(t), "path", ["size", "mtime_ns"])


@query("""
SELECT event_id, concat_ws('; ', CASE WHEN event_type <> 'view' THEN 'model ' || event_type || ' is not view' END, CASE WHEN k IS DISTINCT FROM 7 THEN 'vector dimension ' || coalesce(CAST(k AS VARCHAR), 'missing') || ' is not 7' END,
       CASE WHEN user_id % 5 <> 4 THEN 'schema version ' || (user_id % 5) || ' is not 4' END) AS reason
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)""")
def generation_incompatibility(t: Tables) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    reason = changes.incompatibility(F.col("event_type"), k, (F.col("user_id") % 5).cast("int"), F.lit("float32"), want=("view", 7, 4, "float32"))
    return t.events.select("event_id", reason.alias("reason"))


@query("""
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT'
UNION ALL SELECT o_orderkey, 'X', o_totalprice + 1 FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT -1 - o_orderkey, 'N', CAST(0 AS DOUBLE) FROM orders WHERE o_orderstatus = 'P'""")
def upsert_merge(t: Tables) -> DataFrame:
    target = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    newer = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    added = t.orders.where("o_orderstatus = 'P'").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit(0.0).alias("o_totalprice"))
    return mutations.upsert(target, newer.unionByName(added), "o_orderkey")


@query("""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'P')
UNION ALL SELECT o_orderkey, 1, CAST(o_custkey AS DOUBLE) FROM orders WHERE o_orderpriority = '1-URGENT'""")
def replace_files(t: Tables) -> DataFrame:
    replaced = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey"))
    removed = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = replaced.select("l_orderkey", F.lit(1).alias("l_linenumber"), F.col("o_custkey").cast("double").alias("l_quantity"))
    return mutations.replace_children(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), rows, "l_orderkey", replaced=replaced, removed=removed)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def delete_files(t: Tables) -> DataFrame:
    removed = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return mutations.delete_children(t.lineitem, removed, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_nationkey = 7 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey IN (3, 7)")
def noop_suppression(t: Tables) -> DataFrame:
    target = t.customer.select("c_custkey", "c_name", "c_acctbal", F.lit(1).alias("updated_at"))
    again = t.customer.select("c_custkey", F.when(F.col("c_nationkey") != 3, F.col("c_name")).alias("c_name"), F.when(F.col("c_nationkey") == 7, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"), F.lit(2).alias("updated_at"))
    return mutations.changed_rows(target, again, "c_custkey", ignore=["updated_at"]).drop("updated_at")


@query("SELECT doc_id AS file_id, sha256(text) AS content_hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality + 3 = 4)")
def coverage_missing(t: Tables) -> DataFrame:
    files = t.documents.select(F.col("doc_id").alias("file_id"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    coverage = t.labels.select(F.col("doc_id").alias("file_id"), (F.col("quality") + 3).alias("schema_version")).join(files, "file_id")
    return changes.without_coverage(files, coverage, 4)


@query("""
WITH d AS (SELECT doc_id, sha256(text) AS was, sha256(CASE WHEN lang = 'de' THEN text || ' ' ELSE text END) AS now FROM documents)
SELECT doc_id, was FROM d WHERE was = now""")
def stale_hash_suppression(t: Tables) -> DataFrame:
    from strataquery.operators.references import fresh_only

    hashed = lambda x: F.sha2(x.cast("binary"), 256)
    path = F.concat_ws("/", "source", "doc_id")
    coverage = t.documents.select(path.alias("path"), hashed(F.col("text")).alias("content_hash"))
    current = t.documents.select(path.alias("path"), hashed(F.when(F.col("lang") == "de", F.concat("text", F.lit(" "))).otherwise(F.col("text"))).alias("content_hash"))
    hits = t.documents.select("doc_id", path.alias("path"), hashed(F.col("text")).alias("was"))
    return fresh_only(hits, coverage, current)[0].select("doc_id", "was")


@query("SELECT event_type AS reason, count(*) AS files, (SELECT string_agg(p, ' ' ORDER BY p) FROM (SELECT lpad(CAST(e2.event_id AS VARCHAR), 8, '0') AS p FROM events e2 WHERE e2.event_type = e.event_type ORDER BY p LIMIT 20)) AS sample FROM events e GROUP BY event_type")
def skip_histogram(t: Tables) -> DataFrame:
    return changes.skip_report(t.events.select(F.col("event_type").alias("reason"), F.lpad(F.col("event_id").cast("string"), 8, "0").alias("path")))


@query("""
SELECT count(*) FILTER (WHERE o = 'indexed') AS indexed, count(*) FILTER (WHERE o = 'unchanged') AS unchanged, count(*) FILTER (WHERE o = 'skipped') AS skipped, count(*) FILTER (WHERE o = 'failed') AS failed,
       CAST(sum(user_id) AS BIGINT) AS chunks, CAST(sum(ms) AS BIGINT) AS duration_ms, round(CAST(sum(user_id) AS DOUBLE) * 1000 / CAST(sum(ms) AS DOUBLE), 6) AS chunks_per_second
FROM (SELECT user_id, CAST(floor(value * 10) AS BIGINT) AS ms, CASE event_type WHEN 'click' THEN 'indexed' WHEN 'view' THEN 'unchanged' WHEN 'signup' THEN 'skipped' WHEN 'error' THEN 'failed' ELSE 'other' END AS o FROM events)""")
def run_report(t: Tables) -> DataFrame:
    outcome = F.when(F.col("event_type") == "click", "indexed").when(F.col("event_type") == "view", "unchanged").when(F.col("event_type") == "signup", "skipped").when(F.col("event_type") == "error", "failed").otherwise("other")
    rows = t.events.select(outcome.alias("outcome"), F.col("user_id").alias("chunks"), F.floor(F.col("value") * 10).cast("long").alias("duration_ms"))
    return changes.run_report(rows).withColumn("chunks_per_second", F.round("chunks_per_second", 6))


@query("SELECT user_id AS project_id, CASE WHEN bool_or(event_type = 'error' AND NOT starts_with(coalesce(CASE WHEN value > 90 THEN NULL WHEN value > 1 THEN 'rejected: x' ELSE 'broken' END, ''), 'rejected:')) THEN 'partial' ELSE 'ready' END AS state FROM events GROUP BY user_id")
def project_state(t: Tables) -> DataFrame:
    error = F.when(F.col("value") > 90, F.lit(None)).when(F.col("value") > 1, "rejected: x").otherwise("broken")
    bad = changes.genuine_error(F.col("event_type") == "error", error)
    return t.events.groupBy(F.col("user_id").alias("project_id")).agg(F.when(F.bool_or(bad), "partial").otherwise("ready").alias("state"))


@query("""
SELECT lang AS language, count(*) AS files, string_agg(p, ', ' ORDER BY p) FILTER (WHERE n <= 10) || CASE WHEN count(*) > 10 THEN ' and ' || (count(*) - 10) || ' more' ELSE '' END AS sample
FROM (SELECT lang, p, row_number() OVER (PARTITION BY lang ORDER BY p) AS n FROM (SELECT lang, source || '/' || doc_id AS p FROM documents)) WHERE lang NOT IN ('en', 'fr') GROUP BY lang""")
def coverage_by_language(t: Tables) -> DataFrame:
    return changes.coverage_gaps(t.documents.select(F.col("lang").alias("language"), F.concat_ws("/", "source", "doc_id").alias("path")), ["en", "fr"])


@query("SELECT source AS project_id, count(*) AS chunks FROM documents GROUP BY source")
def project_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.col("source").alias("project_id")).agg(F.count(F.lit(1)).alias("chunks"))


@query("""
SELECT source AS project_id, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS chunks, count(quality) AS covered, coalesce(bool_or(quality = 0), false) AS has_errors
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def project_status(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", F.size(F.split("text", "\n")).cast("long").alias("lines")).join(t.labels, "doc_id", "left")
    return rows.groupBy(F.col("source").alias("project_id")).agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("chunks"), F.count("quality").alias("covered"), F.coalesce(F.bool_or(F.col("quality") == 0), F.lit(False)).alias("has_errors"))


@query("SELECT l_returnflag || l_linestatus AS name, count(*) AS rows, CAST(sum(l_quantity) AS BIGINT) AS bytes FROM lineitem GROUP BY ALL")
def storage_rollup(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus").alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").cast("long").alias("bytes"))


@query("""
WITH f AS (SELECT l_linestatus AS "table", l_suppkey, count(*) AS rows, CAST(sum(l_quantity) AS BIGINT) AS bytes FROM lineitem GROUP BY ALL)
SELECT "table", CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS fragments, min(rows) AS min_rows, max(rows) AS max_rows, round(avg(rows), 6) AS mean_rows,
       round(quantile_cont(rows, 0.25), 6) AS p25, round(quantile_cont(rows, 0.5), 6) AS p50, round(quantile_cont(rows, 0.75), 6) AS p75, round(quantile_cont(rows, 0.99), 6) AS p99 FROM f GROUP BY "table" """)
def table_stats(t: Tables) -> DataFrame:
    fragments = t.lineitem.groupBy(F.col("l_linestatus").alias("table"), "l_suppkey").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").cast("long").alias("bytes"))
    return stats.fragment_stats(fragments)


@query("""
WITH f AS (SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS physical_bytes, count(*) * 25 AS logical_bytes FROM lineitem GROUP BY l_suppkey)
SELECT CAST(sum(greatest(0, physical_bytes - logical_bytes)) AS BIGINT) AS reclaimable FROM f""")
def reclaimable_bytes(t: Tables) -> DataFrame:
    return stats.reclaimable(t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").cast("long").alias("physical_bytes"), (F.count(F.lit(1)) * 25).alias("logical_bytes")))


@query("""
WITH v AS (SELECT l_shipmode AS name, 0 AS x FROM (SELECT CAST(l_suppkey AS VARCHAR) AS l_shipmode FROM lineitem)),
a AS (SELECT CAST(l_suppkey AS VARCHAR) AS name, count(DISTINCT l_linenumber) AS v0, CAST(sum(l_quantity) AS BIGINT) AS b0 FROM lineitem GROUP BY l_suppkey),
b AS (SELECT CAST(l_suppkey AS VARCHAR) AS name, count(DISTINCT l_linestatus) AS v1, CAST(sum(l_quantity) AS BIGINT) AS b1 FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_suppkey)
SELECT name, greatest(0, v0 - v1) AS versions_removed, b0 - b1 AS bytes_reclaimed FROM a JOIN b USING (name)""")
def maintenance_delta(t: Tables) -> DataFrame:
    def measured(rows: DataFrame, versions: str) -> DataFrame:
        return rows.groupBy(F.col("l_suppkey").cast("string").alias("name")).agg(F.count_distinct(versions).alias("versions"), F.sum("l_quantity").cast("long").alias("bytes"))

    return stats.maintenance_delta(measured(t.lineitem, "l_linenumber"), measured(t.lineitem.where("l_returnflag <> 'R'"), "l_linestatus"))


@query("""
WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events)
SELECT event_type, count(*) AS count, round(sum(value), 3) AS total_ms, round(min(value), 3) AS min_ms, round(median(value), 3) AS median_ms, round(quantile_disc(value, 0.95), 3) AS p95_ms, round(max(value), 3) AS max_ms,
       round(avg(value) FILTER (WHERE i <= greatest(1, c // 10)), 3) AS first_decile_mean_ms, round(avg(value) FILTER (WHERE i > c - greatest(1, c // 10)), 3) AS last_decile_mean_ms FROM n GROUP BY event_type""")
def duration_summary(t: Tables) -> DataFrame:
    return metrics.duration_summary(t.events, "event_type", "value", "event_id")


@query("SELECT user_id, CAST(sum(k) AS BIGINT) AS sum_k, max(value) AS max_value, arg_min(event_type, event_id) AS first_event_type, arg_max(purchase, event_id) AS last_purchase FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type = 'purchase' THEN value END AS purchase FROM events) GROUP BY user_id")
def telemetry_rollup(t: Tables) -> DataFrame:
    rows = t.events.withColumn("k", F.from_json("props", "k long")["k"]).withColumn("purchase", F.when(F.col("event_type") == "purchase", F.col("value")))
    return metrics.telemetry(rows, "user_id", "event_id", sums=["k"], maxima=["value"], firsts=["event_type"], lasts=["purchase"])


@query("""
WITH a AS (SELECT source, sha256(text) AS d FROM documents),
b AS (SELECT source, left(d, 4) AS r, sha256(string_agg(d, chr(0) ORDER BY d)) AS d FROM a GROUP BY source, left(d, 4)),
c AS (SELECT source, left(r, 2) AS r, sha256(string_agg(d, chr(0) ORDER BY r)) AS d FROM b GROUP BY source, left(r, 2))
SELECT source, sha256(string_agg(d, chr(0) ORDER BY r)) AS digest FROM c GROUP BY source""")
def corpus_digest(t: Tables) -> DataFrame:
    return metrics.ordered_digest(t.documents, "source", "text")


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_content(t: Tables) -> DataFrame:
    hashed = t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("""
WITH n AS (SELECT user_id, value, epoch_us(ts) AS t0, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) - epoch_us(ts) AS span FROM events)
SELECT user_id, CAST(coalesce(sum(CASE WHEN value > 50 THEN coalesce(span, 0) ELSE 0 END), 0) AS BIGINT) AS breach, max(value) AS peak, round(arg_max(value, t0) - arg_min(value, t0), 6) AS growth FROM n GROUP BY user_id""")
def memory_gate(t: Tables) -> DataFrame:
    samples = t.events.select("user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return metrics.breach_seconds(samples, "user_id", "at", "value", 50.0).withColumn("growth", F.round("growth", 6))


_RUNS = "(SELECT event_id AS run_id, user_id AS project_id, ts AS started_at, CASE WHEN event_type <> 'error' THEN ts END AS finished_at, value FROM events)"


def _runs(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("project_id"), F.col("ts").alias("started_at"), F.when(F.col("event_type") != "error", F.col("ts")).alias("finished_at"), "value")


@query(f"SELECT run_id, project_id FROM {_RUNS} WHERE started_at >= TIMESTAMP '2024-02-05 00:00:00' - INTERVAL 30 DAYS QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, run_id DESC) <= 100")
def history_retention(t: Tables) -> DataFrame:
    return windows.retained_runs(_runs(t), F.lit("2024-02-05 00:00:00").cast("timestamp_ntz")).select("run_id", "project_id")


@query(f"SELECT project_id, arg_max(run_id, started_at) AS run_id FROM {_RUNS} WHERE finished_at IS NOT NULL GROUP BY project_id")
def latest_finished(t: Tables) -> DataFrame:
    return windows.latest_finished(_runs(t), project="project_id", started="started_at", finished="finished_at", row="run_id")


@query("""
WITH s AS (SELECT event_id AS slot_id, user_id AS project_id, ts, event_type = 'purchase' AS protected, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT slot_id, project_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts, slot_id) AS r FROM s WHERE NOT protected) WHERE r <= n - 40""")
def lru_evict(t: Tables) -> DataFrame:
    slots = t.events.select(F.col("event_id").alias("slot_id"), F.col("user_id").alias("project_id"), F.col("ts").alias("last_used_at"), (F.col("event_type") == "purchase").alias("protected"))
    return windows.evicted(slots, 40, protected=F.col("protected")).select("slot_id", "project_id")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 32")
def keep_newest(t: Tables) -> DataFrame:
    return windows.newest(t.events, None, [F.col("ts").desc(), F.col("event_id").desc()], 32).select("event_id", "event_type")


_STATES = "CASE WHEN event_type = 'error' AND (user_id = 0 OR user_id NOT IN (3, 5, 8)) THEN 'interrupted' WHEN event_type = 'error' THEN 'running' ELSE 'finished' END"


@query(f"SELECT event_id AS run_id, {_STATES} AS state FROM events")
def interrupted_runs(t: Tables) -> DataFrame:
    from strataquery.sources.history import interrupted

    runs = t.events.select(F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "error", "running").otherwise("finished").alias("state"), F.col("user_id").alias("pid"))
    return interrupted(runs, [3, 5, 8]).select("run_id", "state")


@query("SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 50 OFFSET 200")
def offset_page(t: Tables) -> DataFrame:
    return paging.offset_page(t.events, [F.col("ts"), F.col("event_id")], 200, 50).select("event_id", "user_id")


@query("SELECT event_id, value FROM events WHERE (value, event_id) < (50.0, 5000) ORDER BY value DESC, event_id DESC LIMIT 21")
def keyset_page(t: Tables) -> DataFrame:
    return paging.keyset_page(t.events.select("event_id", "value"), ["value", "event_id"], (50.0, 5000), 20)


@query("SELECT event_id AS reference_id, event_type FROM events WHERE event_id IN (SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 100)")
def page_semijoin(t: Tables) -> DataFrame:
    from strataquery.operators.references import on_page

    findings = t.events.select(F.col("event_id").alias("reference_id"), "event_type")
    return on_page(findings, paging.offset_page(t.events, [F.col("value").desc(), F.col("event_id")], 0, 100).select(F.col("event_id").alias("reference_id")))


@query("""
SELECT c_custkey, c_nationkey AS project_id, coalesce(c_custkey = a.slot, false) AS active, epoch AS activation_epoch
FROM customer LEFT JOIN (SELECT c_nationkey AS p, max(c_custkey) AS slot, count(*) AS epoch FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'MACHINERY' GROUP BY 1) a ON p = c_nationkey""")
def active_slot_join(t: Tables) -> DataFrame:
    slots = t.customer.select("c_custkey", F.col("c_custkey").alias("slot_id"), F.col("c_nationkey").alias("project_id"))
    named = t.customer.where("c_acctbal > 0 AND c_mktsegment = 'MACHINERY'").groupBy(F.col("c_nationkey").alias("project_id")).agg(F.max("c_custkey").alias("slot_id"), F.count(F.lit(1)).alias("activation_epoch"))
    return graphs.active(slots, named).drop("slot_id")


@query("SELECT user_id AS project_id, event_type AS phase, CAST(sum(k) AS BIGINT) AS total_ms, count(*) AS runs FROM (SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY user_id, event_type")
def phase_rollup(t: Tables) -> DataFrame:
    from strataquery.sources.history import phase_totals

    spent = F.to_json(F.create_map("event_type", F.from_json("props", "k long")["k"]))
    return phase_totals(t.events.select(F.col("user_id").alias("project_id"), spent.alias("phase_durations")))
