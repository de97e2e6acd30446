"""Queries over scans, predicates, paths and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.functions import paths, scalars, text, vectors
from strataquery.operators import changes, windows
from strataquery.plans.base import Tables, query


@query("SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3' AND n_chars > 500")
def scan_filter_project(t: Tables) -> DataFrame:
    return t.documents.where((F.col("source") == "src3") & (F.col("n_chars") > 500)).select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 25")
def scan_ordered_limit(t: Tables) -> DataFrame:
    return t.documents.where(F.col("lang") == "en").select("doc_id", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(25)


@query("SELECT doc_id, source, n_chars > 4096 AS oversize FROM documents")
def scan_metadata_oversize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", (F.col("n_chars") > 4096).alias("oversize"))


@query("SELECT count(*) > 0 AS has_source FROM pages WHERE url LIKE '%.html'")
def source_exists(t: Tables) -> DataFrame:
    found = not t.pages.where(F.col("url").endswith(".html")).limit(1).isEmpty()
    return t.spark.range(1).select(F.lit(found).alias("has_source"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'error') AND user_id IN (3, 5, 8, 13)")
def filter_in_lists(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type").isin("click", "error") & F.col("user_id").isin(3, 5, 8, 13)).select("event_id", "event_type", "value")


_PATH = r"rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/')"


def _page_paths(t: Tables) -> DataFrame:
    return t.pages.select("page_id", "url", F.rtrim(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""), F.lit("/")).alias("path"))


@query(rf"""
SELECT page_id, path FROM (SELECT page_id, {_PATH} AS path FROM pages)
WHERE regexp_matches(path, '(^|/)[^/]*\.html$') OR regexp_matches(path, '(^|/)[de][^/]/1[^/]*$')""")
def filter_path_glob(t: Tables) -> DataFrame:
    return _page_paths(t).where(paths.path_matches(F.col("path"), ["*.html", "[de]?/1*"])).select("page_id", "path")


@query(rf"SELECT page_id, path FROM (SELECT page_id, {_PATH} AS path FROM pages) WHERE regexp_matches(path, '(^|/)[a-e][^/]/[^/]*$')")
def filter_path_glob_fallback(t: Tables) -> DataFrame:
    return _page_paths(t).where(paths.path_matches(F.col("path"), ["[a-e]?/*"])).select("page_id", "path")


_CLASSES = " ".join(f"WHEN regexp_matches(path, '[^/]\\{s}$') THEN '{lang}'" for s, lang in paths.LANGUAGES.items())
_DIRS = "list_has_any(string_split(path, '/')[:-2], ['" + "', '".join(paths.EXCLUDED_FOLDERS) + "'])"
_FAKE = rf"regexp_replace(CASE page_id % 4 WHEN 0 THEN replace({_PATH}, '/en/', '/node_modules/') || '.ts' WHEN 1 THEN {_PATH} || '.py' WHEN 2 THEN {_PATH} || '.txt' ELSE {_PATH} || '.tsx' END, '//', '/')"


def _fake_sources(t: Tables) -> DataFrame:
    """Page paths with suffixes by id, so that all classes of path occur."""
    p, k = F.col("path"), F.col("page_id") % 4
    fake = F.when(k == 0, F.concat(F.replace(p, F.lit("/en/"), F.lit("/node_modules/")), F.lit(".ts"))).when(k == 1, F.concat(p, F.lit(".py"))).when(k == 2, F.concat(p, F.lit(".txt"))).otherwise(F.concat(p, F.lit(".tsx")))
    return _page_paths(t).withColumn("path", F.replace(fake, F.lit("//"), F.lit("/"))).join(t.pages.select("page_id", F.octet_length("html").cast("long").alias("size")), "page_id")


@query(rf"""
WITH p AS (SELECT page_id, replace({_FAKE}, '//', '/') AS path, strlen(html) AS size FROM pages),
c AS (SELECT *, CASE {_CLASSES} END AS language FROM p)
SELECT page_id, language, CASE WHEN {_DIRS} THEN 'hard_excluded' WHEN language IS NULL THEN 'unsupported' WHEN size > 8192 THEN 'oversize' ELSE 'candidate' END AS status FROM c""")
def filter_path_classify(t: Tables) -> DataFrame:
    path = F.col("path")
    return _fake_sources(t).select("page_id", paths.language_of(path).alias("language"), paths.classify(path, F.col("size"), largest=8192).alias("status"))


@query(rf"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages)
SELECT page_id, regexp_matches(path, '^(.*/)?(de|es)/.*$') AND NOT regexp_matches(path, '^(.*/)?[^/]*\.html(/.*)?$') AS ignored FROM p""")
def ignore_rules(t: Tables) -> DataFrame:
    return _page_paths(t).select("page_id", paths.is_ignored(F.col("path"), ["# comment", "de/", "es/", "!*.html"]).alias("ignored"))


@query(r"""
WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'x' || chr(1) ELSE '' END AS mark, text FROM documents)
SELECT doc_id, CASE WHEN mark <> '' THEN 'binary' END AS rejection FROM d""")
def content_rejection(t: Tables) -> DataFrame:
    content = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("text").cast("binary"), F.lit(b"\x00"))).otherwise(F.col("text").cast("binary"))
    return t.documents.select("doc_id", changes.rejection(content).alias("rejection"))


@query(r"""
SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(p_type || 'HTTPServer' || p_name || 'Key2Id', '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))) AS terms FROM part""")
def normalize_identifier(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.normalize_identifier(F.concat("p_type", F.lit("HTTPServer"), "p_name", F.lit("Key2Id"))).alias("terms"))


@query("""
SELECT doc_id, 'language: ' || lang || chr(10) || 'path: ' || source || '/' || doc_id || chr(10) || 'kind: module' AS header,
       sha256('language: ' || lang || chr(10) || 'path: ' || source || '/' || doc_id || chr(10) || 'kind: module' || chr(10) || text) AS passage FROM documents""")
def context_header(t: Tables) -> DataFrame:
    header = text.context_header(F.col("lang"), F.concat_ws("/", "source", "doc_id"), F.lit("module"), F.lit(None).cast("string"))
    return t.documents.select("doc_id", header.alias("header"), text.content_hash(text.passage(header, F.col("text"))).alias("passage"))


@query(r"""
SELECT p_partkey, split_part(q, '.', -1) AS tail, regexp_extract(q, '^(.*)\.[^.]*$', 1) AS owner, p_name AS unquoted, regexp_replace(k, '_part$', '') AS kind
FROM (SELECT *, p_brand || '.' || replace(p_name, ' ', '.') AS q, CASE WHEN p_size > 25 THEN lower(p_type) || '_part' ELSE lower(p_type) END AS k FROM part)""")
def symbol_strings(t: Tables) -> DataFrame:
    q = F.concat_ws(".", "p_brand", F.replace("p_name", F.lit(" "), F.lit(".")))
    kind = F.when(F.col("p_size") > 25, F.concat(F.lower("p_type"), F.lit("_part"))).otherwise(F.lower("p_type"))
    return t.part.select("p_partkey", text.last_segment(q).alias("tail"), text.owner(q).alias("owner"), text.strip_quotes(F.concat(F.lit(' "'), "p_name", F.lit('" '))).alias("unquoted"), text.without_part(kind).alias("kind"))


_NOT_NAME = "[^A-Za-z0-9_$]"


@query(rf"""
SELECT doc_id, CASE WHEN len(regexp_extract_all(' ' || regexp_replace(text, '({_NOT_NAME})', '\1\1', 'g') || ' ', '{_NOT_NAME}that{_NOT_NAME}')) = 1
  THEN length(regexp_extract(text, '(?s)^((?:.*{_NOT_NAME})?)that(?:{_NOT_NAME}.*)?$', 1)) END AS place FROM documents""")
def sole_identifier(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.sole_position(F.col("text"), F.lit("that")).cast("long").alias("place"))


@query("SELECT doc_id, strlen(text) AS bytes, length(text) AS chars, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS newlines, CAST(length(left(text, 100)) - length(replace(left(text, 100), chr(10), '')) + 1 AS BIGINT) AS line FROM documents")
def byte_to_line(t: Tables) -> DataFrame:
    body = F.col("text")
    return t.documents.select("doc_id", F.octet_length(body).cast("long").alias("bytes"), F.length(body).cast("long").alias("chars"), text.newlines(body).alias("newlines"), text.line_at(body, F.lit(100)).alias("line"))


@query("SELECT doc_id, sha256(text) AS content_hash, sha256(source || chr(0) || lang || chr(0) || doc_id) AS chunk_id FROM documents")
def content_digest(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.content_hash(F.col("text")).alias("content_hash"), text.joined_hash(F.col("source"), F.col("lang"), F.col("doc_id")).alias("chunk_id"))


@query("SELECT doc_id, left(text, 4000) AS snippet, length(text) > 4000 AS truncated FROM documents")
def snippet_cut(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.snippet(F.col("text")).alias("snippet"), text.truncated(F.col("text")).alias("truncated"))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS name FROM (SELECT page_id, """ + _PATH + r""" AS path FROM pages))
SELECT page_id, folder || '/' || name || '.py' AS plain, folder || '/' || name || '/__init__.py' AS package, regexp_extract(folder, '^(.*)/[^/]*$', 1) || '/' || name || '.ts' AS script,
       CASE WHEN len(string_split(folder, '/')) >= 3 THEN array_to_string(string_split(folder, '/')[:-4], '/') END AS climbed FROM p""")
def module_candidates(t: Tables) -> DataFrame:
    pages = _page_paths(t).select("page_id", paths.folder_of(F.col("path")).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    dotted = paths.python_module_paths(F.concat(F.lit("."), F.replace("name", F.lit("."), F.lit("/"))), F.col("folder"), F.lit(""))
    script = paths.script_module_paths(F.concat(F.lit("../"), "name"), F.col("folder"))
    climbed = paths.resolve_relative(F.col("folder"), F.lit("../../.."))
    plain = F.regexp_replace(F.get(dotted, F.lit(0)), r"/html\.py$", ".html.py")
    package = F.regexp_replace(F.get(dotted, F.lit(1)), r"/html/__init__\.py$", ".html/__init__.py")
    return pages.select("page_id", plain.alias("plain"), package.alias("package"), F.get(script, F.lit(0)).alias("script"), climbed.alias("climbed"))


@query("""
SELECT event_id, round(CASE WHEN 1 / (value + 1) - 1 / CAST(100 AS DOUBLE) > 0 THEN greatest(0, value - 5) / (1 / (value + 1) - 1 / CAST(100 AS DOUBLE)) END, 6) AS crossover FROM events""")
def crossover_formula(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(scalars.crossover(F.col("value") - 5, F.col("value") + 1, F.lit(100.0)), 6).alias("crossover"))


@query("""
SELECT event_id, CAST(greatest(1024, least(floor(4096 * CAST(m AS DOUBLE) / 2147483648), 32768)) AS BIGINT) AS budget, CASE WHEN k > 0 THEN length(bin(k)) ELSE 0 END AS bucket
FROM (SELECT event_id, user_id * 268435456 AS m, user_id AS k FROM events)""")
def token_budget(t: Tables) -> DataFrame:
    return t.events.select("event_id", scalars.token_budget(F.col("user_id") * 268435456).alias("budget"), scalars.length_bucket(F.col("user_id")).cast("long").alias("bucket"))


@query("""
SELECT event_id, least(CAST(1 AS DOUBLE), CASE WHEN user_id = 0 THEN NULL ELSE CAST(event_id % 500 AS DOUBLE) / user_id END) AS fraction,
       CASE WHEN user_id = 0 THEN NULL ELSE 12000 / CAST(user_id AS DOUBLE) END AS rate FROM events""")
def progress_fraction(t: Tables) -> DataFrame:
    return t.events.select("event_id", scalars.progress_fraction(F.col("event_id") % 500, F.col("user_id")).alias("fraction"), scalars.rate_per_second(F.lit(12), F.col("user_id")).alias("rate"))


@query("""
SELECT user_id, event_id, date_diff('millisecond', lag(ts) OVER w, ts) AS elapsed_ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def elapsed_between(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag(F.date_trunc("MILLISECOND", "ts")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("user_id", "event_id", scalars.elapsed_ms(before, F.date_trunc("MILLISECOND", "ts")).alias("elapsed_ms"))


@query("""
SELECT vec_id, len(embedding) = 64 AND abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) <= CAST(0.1 AS DOUBLE) AS valid FROM embeddings""")
def probe_validity(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", vectors.valid_probe(F.col("embedding"), 64).alias("valid"))


# Half precision keeps eleven bits of a number's own power of two, ten from 2**-14 down; ties go to even.
_HALF = "list_transform(v, lambda x: CASE WHEN x = 0 THEN 0 ELSE round_even(x * pow(2, 10 - greatest(floor(log2(abs(x))), -14)), 0) / pow(2, 10 - greatest(floor(log2(abs(x))), -14)) END)"


@query(f"""
WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), h AS (SELECT vec_id, v, {_HALF} AS h FROM d)
SELECT vec_id, round(list_dot_product(v, h) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(h, h))), 9) AS cosine FROM h""")
def float16_rounding(t: Tables) -> DataFrame:
    half = t.embeddings.select("vec_id", "embedding", vectors.half_precision(F.col("embedding")).alias("half"))
    return half.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("half")), 9).alias("cosine"))


@query()
def hash_embed(t: Tables) -> DataFrame:
    embedded = t.documents.select("doc_id", vectors.hash_embedding(F.col("text")).alias("v"))
    return embedded.select("doc_id", F.size("v").alias("width"), F.round(vectors.norm(F.col("v")), 6).alias("norm"))


@query("""
WITH n AS (SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n FROM documents)
SELECT doc_id, part, part * 15 + 1 AS start_line, least(part * 15 + 20, n) AS end_line FROM (SELECT doc_id, n, unnest(range(0, 1 + greatest(n - 1 - 5, 0) // 15)) AS part FROM n)""")
def line_windows(t: Tables) -> DataFrame:
    cut = t.documents.select("doc_id", F.explode(windows.line_windows(F.col("text"), 20, 5)).alias("w"))
    return cut.select("doc_id", F.col("w.part").cast("long").alias("part"), F.col("w.start_line").cast("long").alias("start_line"), F.col("w.end_line").cast("long").alias("end_line"))


@query("""
WITH n AS (SELECT doc_id, CAST(n_chars AS BIGINT) AS n FROM documents)
SELECT doc_id, part, part * 192 AS first, least(256, n - part * 192) AS n_tokens FROM (SELECT doc_id, n, unnest(range(0, CASE WHEN n > 0 THEN 1 + greatest(n - 1 - 64, 0) // 192 ELSE 0 END)) AS part FROM n)""")
def token_windows(t: Tables) -> DataFrame:
    cut = t.documents.select("doc_id", F.explode(windows.token_windows(F.col("n_chars"), 256, 64)).alias("w"))
    return cut.select("doc_id", *[F.col(f"w.{c}").cast("long").alias(c) for c in ("part", "first", "n_tokens")])


# One step a window: from line i on, the lines that fit into 4096 characters and 200 lines; a longer line alone, in fragments.
@query(r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(text, '[^\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}])|[^\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]+') AS lines FROM documents),
l AS (SELECT doc_id, len(lines) AS n, list_transform(lines, lambda x: length(x)) AS sizes FROM d),
s AS (SELECT doc_id, n, sizes, list_prepend(0, list_transform(range(1, n + 1), lambda i: CAST(list_sum(sizes[1:i]) AS BIGINT))) AS starts FROM l WHERE n > 0),
w AS (
  SELECT doc_id, n, sizes, starts, 0 AS i, 0 AS first_part, 0 AS line, CAST(0 AS BIGINT) AS stop, 0 AS parts FROM s
  UNION ALL
  SELECT doc_id, n, sizes, starts,
         CASE WHEN long THEN i + 1 WHEN e >= n THEN n ELSE e - CASE WHEN sizes[e + 1] > 4096 THEN 0 ELSE least(20, e - i - 1) END END AS i,
         first_part + parts AS first_part, i AS line, starts[CASE WHEN long THEN i + 2 ELSE e + 1 END] AS stop,
         CASE WHEN long THEN CAST(ceil(sizes[i + 1] / 4096.0) AS INTEGER) ELSE 1 END AS parts
  FROM (
    SELECT *, sizes[i + 1] > 4096 AS long, CAST(i + len(list_filter(range(i + 1, least(n, i + 200) + 1), lambda e: starts[e + 1] - starts[i + 1] <= 4096)) AS INTEGER) AS e
    FROM w WHERE i < n)),
p AS (SELECT *, unnest(range(0, parts)) AS k, len(list_filter(starts, lambda x: x < stop)) AS last FROM w WHERE parts > 0)
SELECT CAST(doc_id AS BIGINT) AS key, CAST(first_part + k AS BIGINT) AS part, starts[line + 1] + 4096 * k AS start,
       CASE WHEN sizes[line + 1] > 4096 THEN least(starts[line + 1] + 4096 * (k + 1), stop) ELSE stop END AS "end", CAST(line + 1 AS BIGINT) AS start_line, CAST(last AS BIGINT) AS end_line FROM p""")
def greedy_line_windows(t: Tables) -> DataFrame:
    return windows.windows_of_lines(t.documents, "doc_id", "text")


@query(r"""
WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z') AS pieces FROM documents),
w AS (SELECT doc_id, text, pieces, len(pieces) AS n, unnest(range(0, 1 + greatest(len(pieces) - 1 - 16, 0) // 48)) AS part FROM p),
c AS (SELECT doc_id, part, n, array_to_string(pieces[1:part * 48], '') AS head, array_to_string(pieces[part * 48 + 1:part * 48 + 64], '') AS own FROM w)
SELECT doc_id, part, CAST(strlen(head) AS BIGINT) AS start_byte, CAST(strlen(head) + strlen(own) AS BIGINT) AS end_byte,
       CAST(1 + length(head) - length(replace(head, chr(10), '')) AS BIGINT) AS start_line,
       CAST(1 + length(head || own) - length(replace(head || own, chr(10), '')) AS BIGINT) AS end_line, sha256(own) AS content_hash FROM c""")
def window_chunks(t: Tables) -> DataFrame:
    """Documents as chunks of their own, rebuilt around windows of 64 words."""
    lines = F.lit(1) + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    chunks = t.documents.select("doc_id", F.col("text").alias("content"), F.lit(0).alias("start_byte"), F.octet_length("text").alias("end_byte"), F.lit(1).alias("start_line"), lines.alias("end_line"))
    cut = windows.window_chunks(chunks.withColumn("windows", windows.passage_windows(F.col("content"), 64, 16)), "windows")
    places = [F.col(c).cast("long").alias(c) for c in ("start_byte", "end_byte", "start_line", "end_line")]
    return cut.select("doc_id", F.col("part_index").cast("long").alias("part"), *places, F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))


@query("""
WITH RECURSIVE d AS (SELECT source, doc_id, CAST(ceil(n_chars / 4) AS BIGINT) AS s FROM documents),
o AS (SELECT *, CASE WHEN s > 0 THEN length(bin(s)) ELSE 0 END AS b FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY b, doc_id) AS i FROM o),
r AS (
  SELECT source, doc_id, s, b, i, CAST(0 AS BIGINT) AS batch, 1 AS items, s AS longest FROM n WHERE i = 1
  UNION ALL
  SELECT source, doc_id, s, b, i, batch + CASE WHEN new THEN 1 ELSE 0 END, CASE WHEN new THEN 1 ELSE items + 1 END, CASE WHEN new THEN s ELSE greatest(longest, s) END
  FROM (SELECT n.*, batch, items, longest, n.b <> r.b OR items >= 16 OR (items + 1) * greatest(longest, n.s) > 32768 AS new FROM r JOIN n ON n.source IS NOT DISTINCT FROM r.source AND n.i = r.i + 1))
SELECT source, doc_id, s AS tokens, batch FROM r""")
def microbatch_pack(t: Tables) -> DataFrame:
    tokens = t.documents.select("source", "doc_id", F.ceil(F.col("n_chars") / 4).alias("tokens"))
    return windows.pack(tokens, "source", "doc_id", "tokens", most_items=16, most_size=32768, padded=True)


@query("""
WITH RECURSIVE n AS (SELECT source, doc_id, CAST(n_chars AS BIGINT) AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r AS (
  SELECT source, doc_id, s, i, CAST(0 AS BIGINT) AS batch, 1 AS items, s AS size FROM n WHERE i = 1
  UNION ALL
  SELECT source, doc_id, s, i, batch + CASE WHEN new THEN 1 ELSE 0 END, CASE WHEN new THEN 1 ELSE items + 1 END, CASE WHEN new THEN s ELSE size + s END
  FROM (SELECT n.*, batch, items, size, items >= 64 OR size + n.s > 1048576 AS new FROM r JOIN n ON n.source IS NOT DISTINCT FROM r.source AND n.i = r.i + 1))
SELECT source, doc_id, s AS n_chars, batch FROM r""")
def commit_pack(t: Tables) -> DataFrame:
    return windows.pack(t.documents.select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", most_items=64, most_size=1 << 20)
