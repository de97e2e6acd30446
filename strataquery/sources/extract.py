"""Chunks and structural rows of source files: one parse a file, in Python workers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquery.functions.text import context_header, identifier_terms, passage
from strataquery.functions.vectors import hash_embedding
from strataquery.operators.references import GENERATION
from strataquery.operators.retrieval import postings, terms_of
from strataquery.operators.windows import bounded_line_windows
from strataquery.shipping import ship
from strataquery.sources import extract_lexical, extract_python

#: Languages with structural facts.
STRUCTURAL = ("python", "javascript", "typescript", "tsx")
#: Emitted text over this many times the source is an error of the file.
MOST_GROWTH = 2

PARSED = (
    "file_id string, project_id string, path string, language string, content_hash string, has_errors boolean, error string, "
    "chunks array<struct<kind: string, symbol: string, qualified_symbol: string, parent_symbol: string, start_byte: long, end_byte: long, start_line: int, end_line: int, content: string, part_index: int>>, "
    "rows array<struct<record_kind: string, kind: string, source_qualified_symbol: string, written_name: string, target_name: string, module_path: string, imported_name: string, alias: string, receiver_text: string, "
    "start_byte: long, end_byte: long, start_line: int, end_line: int, shape_json: string>>"
)


def parse(data: bytes, language: str) -> tuple[list[dict], list[dict], bool]:
    if language == "python":
        return extract_python.extract(data)
    return extract_lexical.extract(data, language)


def chunks_of(data: bytes, defined: list[dict]) -> list[dict]:
    """Chunks in order: functions whole, containers up to their first inner definition, and what no definition covers.

    Long chunks are cut into overlapping line windows, whose kind says that
    they are parts.
    """
    source = extract_python.Source(data)
    spans = []
    for d in defined:
        inner = [x["start"] for x in defined if d["start"] < x["start"] and x["end"] <= d["end"]] if d["container"] else []
        spans.append((d["start"], min([d["end"], *inner]), d))
    covered, at, rest = sorted((d["start"], d["end"]) for d in defined), 0, []
    for start, end in [*covered, (len(data), len(data))]:
        if start > at and data[at:start].strip():
            rest.append((at, start, {"kind": "module", "symbol": None, "qualified": None, "parent": None}))
        at = max(at, end)
    out = []
    for start, end, d in sorted([*spans, *rest], key=lambda s: (s[0], s[1], s[2]["kind"])):
        text = data[start:end].decode("utf-8", "replace")
        windows = bounded_line_windows(text)
        for part, (a, b, _, _) in enumerate(windows):
            first = start + len(text[:a].encode())
            last = start + len(text[:b].encode())
            kind = d["kind"] + ("_part" if len(windows) > 1 and d["kind"] != "module" else "")
            content = text[a:b].rstrip()
            if content:
                out.append({"kind": kind, "symbol": d["symbol"], "qualified_symbol": d["qualified"], "parent_symbol": d["parent"], "start_byte": first, "end_byte": last, "start_line": source.line(first), "end_line": source.line(max(first, last - 1)), "content": content, "part_index": part})
    return out


def structural_rows(data: bytes, language: str, defined: list[dict], found: list[dict], errors: bool) -> list[dict]:
    """References, declarations and one coverage row; none but coverage for files with errors."""
    empty = dict.fromkeys(("kind", "source_qualified_symbol", "written_name", "target_name", "module_path", "imported_name", "alias", "receiver_text", "start_byte", "end_byte", "start_line", "end_line", "shape_json"))
    if language not in STRUCTURAL:
        return []
    source = extract_python.Source(data)
    lines = lambda s, e: {"start_byte": s, "end_byte": e, "start_line": source.line(s), "end_line": source.line(max(s, e - 1))}
    rows = []
    if not errors:
        for r in found:
            shape = json.dumps(r["shape"], sort_keys=True) if r["shape"] else None
            rows.append(empty | {"record_kind": "reference", "kind": r["kind"], "source_qualified_symbol": r["source"], "written_name": r["written"], "target_name": r["target"], "module_path": r["module"], "imported_name": r["imported"], "alias": r["alias"], "receiver_text": r["receiver"], "shape_json": shape} | lines(r["start"], r["end"]))
        for d in defined:
            rows.append(empty | {"record_kind": "declaration", "kind": d["kind"], "written_name": d["symbol"], "target_name": d["qualified"], "source_qualified_symbol": d["parent"], "shape_json": json.dumps(d["parameters"], sort_keys=True)} | lines(d["start"], d["end"]))
        rows.append(empty | {"record_kind": "coverage"})
    return rows


def extract(files: DataFrame) -> DataFrame:
    """One row a file with its chunks and structural rows; ``files`` has file_id, project_id, path, language and content.

    A file that can't be handled gets an error and no rows; the others go on.
    """
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for f in frame.itertuples(index=False):
                data = f.content
                base = {"file_id": f.file_id, "project_id": f.project_id, "path": f.path, "language": f.language, "content_hash": None, "has_errors": True, "error": None, "chunks": [], "rows": []}
                if data is None:
                    out.append(base | {"error": "the file can't be read"})
                    continue
                base["content_hash"] = hashlib.sha256(data).hexdigest()
                reason = "binary" if b"\0" in data else None
                try:
                    data.decode("utf-8")
                except UnicodeDecodeError:
                    reason = reason or "encoding"
                if reason:
                    out.append(base | {"error": f"rejected: {reason}"})
                    continue
                try:
                    defined, found, errors = parse(data, f.language)
                    cut = chunks_of(data, defined)
                    if sum(len(c["content"]) for c in cut) > MOST_GROWTH * max(len(data), 4096):
                        raise ValueError("chunks are far larger than the file")
                    out.append(base | {"has_errors": errors, "chunks": cut, "rows": structural_rows(data, f.language, defined, found, errors)})
                except Exception as error:  # one file's trouble is that file's error, not the run's
                    out.append(base | {"error": f"{type(error).__name__}: {error}"[:500]})
            yield pd.DataFrame(out, columns=["file_id", "project_id", "path", "language", "content_hash", "has_errors", "error", "chunks", "rows"])

    return files.select("file_id", "project_id", "path", "language", "content").mapInPandas(run, PARSED)


def chunk_rows(parsed: DataFrame, slot_id: str, embed: Callable[[Column], Column] = hash_embedding) -> DataFrame:
    """Chunk table rows with ids, search terms and the vectors that ``embed`` gives for a chunk's passage."""
    c = parsed.select("project_id", "file_id", "path", "language", "content_hash", F.explode("chunks").alias("c")).select("project_id", "file_id", "path", "language", "content_hash", "c.*")
    parts = [F.lit(slot_id), F.col("file_id"), F.col("content_hash"), F.col("kind"), F.coalesce("qualified_symbol", F.lit("")), F.col("start_byte"), F.col("end_byte"), F.col("part_index")]
    digest = F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]).cast("binary"), 256)
    header = context_header(F.col("language"), F.col("path"), F.col("kind"), F.col("qualified_symbol"))
    named = c.withColumn("chunk_id", F.concat_ws(":", "project_id", digest)).withColumn("identifier_terms", identifier_terms(F.col("path"), F.col("qualified_symbol"), F.col("symbol"))).withColumn("vector", embed(passage(header, F.col("content"))))
    return named.withColumns({"content_length": F.size(terms_of(F.col("content"))), "identifier_length": F.size(terms_of(F.col("identifier_terms")))})


def posting_rows(chunks: DataFrame) -> DataFrame:
    """Rows of the text index of ``chunk_rows``."""
    parts = [postings(chunks, "chunk_id", text, ["file_id"]).withColumn("field", F.lit(field)) for field, text in (("content", "content"), ("identifier", "identifier_terms"))]
    return parts[0].unionByName(parts[1]).select("file_id", F.col("key").alias("chunk_id"), "field", "term", F.col("tf").cast("int").alias("tf"), "length")


def reference_rows(parsed: DataFrame) -> DataFrame:
    """Structural table rows with ids."""
    r = parsed.select("project_id", "file_id", "path", "language", "content_hash", F.explode("rows").alias("r")).select("project_id", "file_id", "path", "language", "content_hash", "r.*")
    parts = [F.col("file_id"), F.col("record_kind"), F.coalesce("kind", F.lit("")), F.coalesce("start_byte", F.lit(-1)), F.coalesce("end_byte", F.lit(-1)), F.lit(GENERATION)]
    return r.withColumn("reference_id", F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]).cast("binary"), 256)).withColumn("schema_version", F.lit(GENERATION))
