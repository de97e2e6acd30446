"""File enumeration: Git worktrees, folder walks with nested ignore files, and contents."""

from __future__ import annotations

import os
import subprocess
import zlib
from collections.abc import Iterator, Sequence
from contextlib import suppress
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from strataquery.functions import paths

SCANNED = "path string, size long, mtime_ns long, is_link boolean, is_file boolean, ignored boolean"
GIT_SECONDS = 10


def git_paths(root: Path, seconds: float = GIT_SECONDS) -> list[str] | None:
    """Tracked and untracked but not ignored files, sorted; None without Git or in time."""
    command = ["git", "-C", str(root), "ls-files", "-z", "--cached", "--others", "--exclude-standard"]
    try:
        done = subprocess.run(command, capture_output=True, timeout=seconds, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return sorted({os.fsdecode(p) for p in done.stdout.split(b"\0") if p})


def walk_paths(root: Path, ignore_name: str = ".gitignore") -> Iterator[tuple[str, bool]]:
    """(path, ignored) of all files in name order; excluded folders and nested repositories aren't entered.

    Rules of an ignore file hold below its folder, after those from above; the
    last that fits wins.
    """
    import re

    def visit(folder: Path, rules: list[tuple[re.Pattern, bool]]) -> Iterator[tuple[str, bool]]:
        here = folder.relative_to(root).as_posix()
        prefix = "" if here == "." else here + "/"
        own = folder / ignore_name
        if own.is_file():
            found = [paths.ignore_rule_regex(line) for line in own.read_text(errors="replace").splitlines()]
            rules = rules + [(re.compile("^" + re.escape(prefix) + body[1:]), not again) for body, again, _ in filter(None, found)]
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            name = prefix + entry.name
            if entry.is_dir(follow_symlinks=False):
                if entry.name not in paths.EXCLUDED_FOLDERS and not (Path(entry.path) / ".git").exists():
                    yield from visit(Path(entry.path), rules)
                continue
            ignored = False
            for rule, out in rules:
                if rule.search(name):
                    ignored = out
            yield name, ignored

    yield from visit(root, [])


def tree_mark(root: str) -> int:
    """A number that changes when a file below ``root`` is added, removed or written. No content is read."""
    top, mark = Path(root).resolve(), 0
    for path, ignored in walk_paths(top):
        if not ignored:
            with suppress(OSError):
                stat = os.lstat(top / path)
                mark ^= zlib.crc32(f"{path} {stat.st_size} {stat.st_mtime_ns}".encode())
    return mark


def scan(spark: SparkSession, root: str, *, excludes: Sequence[str] = ()) -> DataFrame:
    """One row a path: facts of the file, without its content.

    The listing is the driver's, as it is of one local tree. If Git fails, the
    walk takes over from the start; paths are distinct either way.
    """
    top = Path(root).resolve()
    listed = git_paths(top) if (top / ".git").exists() else None
    found = ((p, False) for p in listed) if listed is not None else walk_paths(top)
    rows = []
    for path, ignored in found:
        full = top / path
        try:
            stat = os.lstat(full)
        except OSError:
            continue
        rows.append((path, stat.st_size, stat.st_mtime_ns, full.is_symlink(), full.is_file(), ignored))
    listing = spark.createDataFrame(rows, SCANNED).dropDuplicates(["path"])
    return listing.withColumn("ignored", F.col("ignored") | paths.is_ignored(F.col("path"), list(excludes)))


def scan_store(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder of any file system that Spark lists: path, size and time, no content read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    home = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    path = paths.relative_to(F.regexp_replace("path", "^file:/+", "file:/"), F.lit(home.replace("file:///", "file:/")))
    return files.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.lit(False).alias("is_link"), F.lit(True).alias("is_file"), F.lit(False).alias("ignored"))


def classified(scanned: DataFrame, *, includes: Sequence[str] = (), largest: int = 1_048_576) -> DataFrame:
    """``scanned`` with language and status; an include list admits only what it matches."""
    path = F.col("path")
    status = paths.classify(path, F.col("size"), is_link=F.col("is_link"), is_file=F.col("is_file"), ignored=F.col("ignored"), largest=largest)
    wanted = paths.path_matches(path, list(includes)) if includes else F.lit(True)
    return scanned.withColumn("language", paths.language_of(path)).withColumn("status", F.when((status != "hard_excluded") & ~wanted, "not_included").otherwise(status))


def with_contents(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (with path) and content: only the files that are asked for are read.

    Paths go to the tasks, and each task opens its own files; their number is
    bounded by what changed, not by the tree.
    """
    from strataquery.shipping import ship

    ship(spark)
    top = str(Path(root).resolve())
    schema = StructType([*wanted.schema.fields, StructField("content", BinaryType())])

    def read(batches):
        for frame in batches:
            content = []
            for path in frame["path"]:
                try:
                    content.append((Path(top) / PurePosixPath(path)).read_bytes())
                except OSError:
                    if not os.path.isdir(top):  # not this file's fault
                        raise RuntimeError(f"the project folder {top} can't be reached from this executor") from None
                    content.append(None)
            yield frame.assign(content=content)

    return wanted.mapInPandas(read, schema)


def has_source(scanned: DataFrame) -> bool:
    """Whether there is any file to index; stops at the first."""
    return not classified(scanned).where("status = 'candidate'").limit(1).isEmpty()


def inspect(scanned: DataFrame, *, statuses: Sequence[str] = (), offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the dry run: path, language and status in path order."""
    rows = classified(scanned).select("path", "language", "status")
    if statuses:
        rows = rows.where(F.col("status").isin(list(statuses)))
    return rows.orderBy("path").offset(offset).limit(limit)
