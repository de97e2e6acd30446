"""String functions over columns."""

from __future__ import annotations

import keyword

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most characters of a snippet.
SNIPPET = 4000


def normalize_identifier(name: Column) -> Column:
    """Words of an identifier in lower case: camel case, acronyms and punctuation become single spaces."""
    split = F.regexp_replace(F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.lower(F.regexp_replace(split, r"[^A-Za-z0-9]+", " ")))


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def owner(name: Column) -> Column:
    """All before the last dot; empty without one."""
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)


def strip_quotes(text: Column) -> Column:
    """``text`` without one pair of equal quotes around it."""
    trimmed = F.trim(text)
    first, quoted = F.left(trimmed, F.lit(1)), F.length(trimmed) >= 2
    return F.when(quoted & first.isin("'", '"', "`") & (F.right(trimmed, F.lit(1)) == first), F.substring(trimmed, F.lit(2), F.length(trimmed) - 2)).otherwise(trimmed)


def strip_splat(name: Column) -> Column:
    """A parameter's name without leading stars or dots."""
    return F.regexp_replace(name, r"^(\*\*|\*|\.\.\.)", "")


def identifier_terms(path: Column, qualified: Column, symbol: Column) -> Column:
    return normalize_identifier(F.concat_ws(" ", path, qualified, symbol))


def context_header(language: Column, path: Column, kind: Column, symbol: Column) -> Column:
    """Lines that name a chunk's language, path, kind and, if it has one, symbol."""
    return F.concat_ws("\n", F.concat(F.lit("language: "), language), F.concat(F.lit("path: "), path), F.concat(F.lit("kind: "), kind), F.concat(F.lit("symbol: "), symbol))


def passage(header: Column, content: Column) -> Column:
    return F.concat_ws("\n", header, content)


def newlines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n")))).cast("long")


def line_at(text: Column, offset: Column) -> Column:
    """Line (from 1) of the character offset (from 0)."""
    return newlines(F.substring(text, F.lit(1), offset.cast("int"))) + 1


def snippet(text: Column) -> Column:
    return F.substring(text, 1, SNIPPET)


def truncated(text: Column) -> Column:
    return F.length(text) > SNIPPET


def without_part(kind: Column) -> Column:
    """A chunk's kind without the suffix that marks a piece of a divided definition."""
    return F.regexp_replace(kind, "_part$", "")


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def joined_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL; null counts as empty."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def is_identifier(name: str, language: str) -> bool:
    """Whether a new name is allowed in the language."""
    if language == "python":
        return name.isidentifier() and not keyword.iskeyword(name)
    head, rest = name[:1], name[1:]
    plain = name.isascii() and bool(name)
    return plain and (head.isalpha() or head in "_$") and all(c.isalnum() or c in "_$" for c in rest)


def sole_position(text: Column, name: Column) -> Column:
    """Place (from 0) of ``name`` as a whole identifier in ``text`` if it is there exactly once, else null."""
    pattern = F.concat(F.lit(r"(?<![A-Za-z0-9_$])\Q"), name, F.lit(r"\E(?![A-Za-z0-9_$])"))
    return F.when(F.regexp_count(text, pattern) == 1, F.length(F.call_function("regexp_extract", text, F.concat(F.lit("(?s)^(.*?)"), pattern), F.lit(1))))
