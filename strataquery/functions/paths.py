"""Path functions: globs, languages, exclusions, module resolution."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquery.shared import unbroadcast
from strataquery.shipping import ship

# The language of each suffix.
LANGUAGES = {
    ".py": "python", ".pyi": "python",
    ".java": "java",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".tsx": "tsx",
    ".cs": "csharp", ".csx": "csharp",
    ".gd": "gdscript",
    ".gdshader": "gdshader", ".gdshaderinc": "gdshader",
    ".tres": "godot_resource", ".tscn": "godot_resource", ".godot": "godot_resource",
    ".sql": "sql",
    ".yaml": "yaml", ".yml": "yaml",
    ".json": "json",
    ".go": "go",
    ".tf": "terraform", ".tfvars": "terraform",
    ".rs": "rust",
    ".c": "c", ".h": "c",
    ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hh": "cpp", ".hpp": "cpp", ".hxx": "cpp",
    ".lua": "lua",
}

# Folders that are never indexed.
EXCLUDED_FOLDERS = (
    ".git", ".strataquery", ".godot", ".venv", "venv", "node_modules", "dist", "build", ".next", ".pytest_cache",
    ".mypy_cache", ".ruff_cache", "__pycache__", "coverage", "htmlcov",
)

# Suffixes and index files that an import without suffix may mean.
SCRIPT_SUFFIXES = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")

_GLOB_PART = re.compile(r"(?P<stars>\*+)|(?P<one>\?)|(?P<set>\[!?\]?[^\]]*\])|(?P<open>\[)|(?P<plain>[^*?\[]+)")


def glob_to_regex(pattern: str) -> str | None:
    """Regex for a right-anchored glob, or None if it has no safe translation.

    A run of stars stays inside one segment. Absolute and empty patterns, sets
    with ranges or characters that regex dialects read differently, and open
    brackets are left to ``PurePosixPath.match``.
    """
    if not pattern or pattern[0] == "/":
        return None
    out = []
    for part in _GLOB_PART.finditer(PurePosixPath(pattern).as_posix()):
        kind, text = part.lastgroup, part.group()
        if kind == "open":
            return None
        if kind == "set":
            inner = text[1:-1]
            sign, members = ("^", inner[1:]) if inner[:1] == "!" else ("", inner)
            if not members or set(members) & set(r"-\/&~|"):
                return None
            out.append("[" + sign + re.sub(r"([\[\]^])", r"\\\1", members) + "]")
        else:
            out.append({"stars": "[^/]*", "one": "[^/]"}.get(kind) or re.escape(text))
    return "(^|/)" + "".join(out) + "$"


def path_matches(path: Column, patterns: Sequence[str]) -> Column:
    """Whether the path matches any of the globs.

    Expressions if all translate; otherwise an Arrow function decides all rows,
    since a pattern left out would lose rows.
    """
    translated = [glob_to_regex(p) for p in patterns]
    if None not in translated:
        return reduce(or_, [path.rlike(r) for r in translated], F.lit(False))
    wanted = tuple(patterns)
    ship(SparkSession.active())

    @F.arrow_udf("boolean")
    def matches(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([None if p is None else any(PurePosixPath(p).match(w) for w in wanted) for p in part.to_pylist()], pa.bool_())

    return matches(path)


def suffix_of(path: Column) -> Column:
    """Lower-case suffix with its dot; empty without one or for names that only start with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    """Language by suffix, null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, suffix_of(path))


def in_excluded_folder(path: Column, folders: Sequence[str] = EXCLUDED_FOLDERS) -> Column:
    """Whether a folder on the way to the file is excluded; the file's own name doesn't count."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, folders)))


def classify(path: Column, size: Column, *, is_link: Column | None = None, is_file: Column | None = None, ignored: Column | None = None, largest: int = 1_048_576) -> Column:
    """Why a path is left out, or ``candidate``."""
    no = F.lit(False)
    return (
        F.when(in_excluded_folder(path), "hard_excluded")
        .when(no if is_link is None else is_link, "symlink")
        .when(no if is_file is None else ~is_file, "not_a_file")
        .when(language_of(path).isNull(), "unsupported")
        .when(no if ignored is None else ignored, "ignored")
        .when(size > largest, "oversize")
        .otherwise("candidate")
    )


def ignore_rule_regex(rule: str) -> tuple[str, bool, bool] | None:
    """(regex over the path, re-includes, folders only) of one ignore-file line; None for blanks and comments.

    Leading and inner ``**/`` stand for any number of folders, a trailing
    ``/**`` for all below, a rule with an inner slash starts at the root.
    """
    line = rule.rstrip("\n").rstrip()
    if not line or line[0] == "#":
        return None
    again = line[0] == "!"
    line = line[1:] if again else line.removeprefix("\\")
    folder = line.endswith("/")
    line = line.rstrip("/")
    rooted = "/" in line
    line = line.lstrip("/")
    tokens = {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]", "**": ".*"}
    body = re.sub(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]*\]|.", lambda m: tokens.get(m[0]) or (("[" + m[0][1:-1].replace("!", "^", 1) + "]") if len(m[0]) > 1 else re.escape(m[0])), line)
    return ("^" if rooted else "^(?:.*/)?") + body + ("/.*$" if folder else "(?:/.*)?$"), again, folder


def is_ignored(path: Column, rules: Sequence[str]) -> Column:
    """Last fitting ignore rule wins; ``!`` includes again."""
    out = F.lit(False)
    for rule in rules:
        if parsed := ignore_rule_regex(rule):
            out = F.when(path.rlike(parsed[0]), F.lit(not parsed[1])).otherwise(out)
    return out


def relative_to(path: Column, prefix: Column) -> Column:
    """The path below ``prefix``, or null if it isn't below it."""
    folder = F.concat(F.rtrim(prefix, F.lit("/")), F.lit("/"))
    return F.when(prefix == "", path).when(F.startswith(path, folder), F.substring(path, F.length(folder) + 1, F.length(path)))


def resolve_relative(folder: Column, target: Column) -> Column:
    """``folder``/``target`` with ``.`` and ``..`` resolved; null if it leaves the root."""
    steps = F.filter(F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), target), "/"), lambda s: ~s.isin("", "."))
    empty = F.array().cast("array<string>")
    stack = F.aggregate(
        steps,
        F.struct(empty.alias("at"), F.lit(True).alias("inside")),
        lambda a, s: F.when(s != "..", F.struct(F.array_append(a["at"], s).alias("at"), a["inside"].alias("inside"))).otherwise(
            F.struct(F.slice(a["at"], F.lit(1), F.greatest(F.size(a["at"]) - 1, F.lit(0))).alias("at"), (a["inside"] & (F.size(a["at"]) > 0)).alias("inside"))
        ),
    )
    return F.transform(F.array(stack), lambda s: F.when(s["inside"], F.array_join(s["at"], "/")))[0]


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def python_module_paths(module: Column, folder: Column, root: Column) -> Column:
    """Files that a dotted module may be; leading dots climb from ``folder``, others start at ``root``."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    name = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    climb = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
    base = F.when(dots > 0, resolve_relative(folder, F.concat(climb, name))).otherwise(F.concat_ws("/", F.nullif(root, F.lit("")), F.nullif(name, F.lit(""))))
    return F.when(base.isNotNull(), F.array(F.concat(base, F.lit(".py")), F.concat_ws("/", F.nullif(base, F.lit("")), F.lit("__init__.py"))))


def script_module_paths(module: Column, folder: Column) -> Column:
    """Files that a relative script import may be: the path with each suffix, and index files below it."""
    base = resolve_relative(folder, module)
    bare = F.regexp_replace(base, r"\.(mjs|cjs|jsx?|mts|cts|tsx?)$", "")
    names = [F.concat(bare, F.lit(s)) for s in SCRIPT_SUFFIXES] + [F.concat(base, F.lit("/index" + s)) for s in SCRIPT_SUFFIXES]
    return F.when(F.startswith(module, F.lit(".")) & base.isNotNull(), F.array(*names))


def package_roots(files: DataFrame) -> DataFrame:
    """path and root of each Python file: the folder above its unbroken run of package folders.

    ``files`` has ``path``. Folders on the way up are exploded and matched
    against the folders with a package marker, so no path is walked in a loop.
    """
    marked = files.where(F.col("path").rlike(r"(^|/)__init__\.py$")).select(folder_of(F.col("path")).alias("package"))
    parts = F.split(folder_of(F.col("path")), "/")
    ups = files.where(F.endswith("path", F.lit(".py"))).withColumn("parts", parts).select("path", "parts", F.explode(F.sequence(F.size("parts"), F.lit(1))).alias("depth"))
    ups = ups.withColumn("up", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/"))
    broken = ups.join(unbroadcast(marked.withColumnRenamed("package", "up")), "up", "left_anti").groupBy("path").agg(F.max("depth").alias("stop"))
    return ups.select("path", "parts").distinct().join(unbroadcast(broken), "path", "left").select("path", F.array_join(F.slice("parts", F.lit(1), F.coalesce("stop", F.lit(0))), "/").alias("root"))
