import random
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from strataquery.functions import paths, scalars, text, vectors

PATTERNS = [
    "*.py", "**/*.py", "src/*", "src/**", "src/**/*.py", "a?c.ts", "[ab]c.py", "[!a]*.py", "test_*.py", "**", "*", "a/b/c", "./x.py", "x.py/", "a//b.py", "*.t[sx]", "[]]x", "[!]]x", "[a^]b", "a.b+c(d)", "{x}", "$a", "é*.py", "a b.py",
    "[a-c].py", "[", "[x", "", "/abs/*.py", "[a&&b]x", "[~]",
]


def some_paths():
    rng = random.Random(0)
    parts = ["src", "a", "b", "c", "abc.ts", "ac.py", "bc.py", "test_x.py", "x.py", "a.b+c(d)", "]x", "$a", "a b.py", "é1.py", "b.py", "{x}"]
    return sorted({"/".join(rng.choice(parts) for _ in range(n)) for n in (1, 2, 3, 4) for _ in range(150)})


def test_globs_equal_pure_path_match():
    import re

    for pattern in PATTERNS:
        rx = paths.glob_to_regex(pattern)
        if rx is None:
            assert not pattern or pattern[0] == "/" or "[" in pattern
            continue
        for p in some_paths():
            assert bool(re.search(rx, p)) == PurePosixPath(p).match(pattern), (pattern, p)


@pytest.mark.parametrize("patterns", [[p] for p in PATTERNS if p] + [["*.py", "[a-c].py"], ["src/*", "*.ts"]])
def test_path_matches_in_plans(spark, patterns):
    df = spark.createDataFrame([(p,) for p in some_paths()], "path string")
    got = {r[0] for r in df.where(paths.path_matches(F.col("path"), patterns)).collect()}
    assert got == {p for p in some_paths() if any(PurePosixPath(p).match(w) for w in patterns)}


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize("path,language", [("a.py", "python"), ("A/B.PYI", "python"), ("x.tsx", "tsx"), ("dir.py/readme", None), (".py", None), ("a.b/.gitignore", None), ("noext", None), ("p.project.godot", "godot_resource")])
def test_languages(spark, path, language):
    assert one(spark, paths.language_of(F.col("p")), p=path) == language


@pytest.mark.parametrize("path,inside", [("node_modules/x.js", True), ("a/venv/b.py", True), ("venv", False), ("src/build.py", False), ("a/.godot/x", True), ("x/project.godot", False)])
def test_excluded_folders(spark, path, inside):
    assert one(spark, paths.in_excluded_folder(F.col("p")), p=path) is inside


@pytest.mark.parametrize("folder,target,result", [("a/b", "./c", "a/b/c"), ("a/b", "../c/./d", "a/c/d"), ("a", "../../x", None), ("", "x", "x"), ("a/b", "..", "a"), ("a", "..", "")])
def test_relative_paths(spark, folder, target, result):
    assert one(spark, paths.resolve_relative(F.col("f"), F.col("t")), f=folder, t=target) == result


@pytest.mark.parametrize("rules,path,ignored", [(["*.log"], "a/b.log", True), (["/x.py"], "a/x.py", False), (["/x.py"], "x.py", True), (["build/"], "a/build/x.py", True), (["*.py", "!keep.py"], "a/keep.py", False), (["**/gen/*.ts"], "gen/a.ts", True), (["doc/**"], "doc/a/b.py", True), (["# *.py", ""], "a.py", False), (["a?.py", "[xy].py"], "x.py", True)])
def test_ignore_rules(spark, rules, path, ignored):
    assert one(spark, paths.is_ignored(F.col("p"), rules), p=path) is ignored


def test_package_roots(spark):
    names = ["src/app/__init__.py", "src/app/core/__init__.py", "src/app/core/x.py", "src/tool.py", "main.py", "src/app/free/y.py"]
    got = {r["path"]: r["root"] for r in paths.package_roots(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert got["src/app/core/x.py"] == "src" and got["src/tool.py"] == "src" and got["main.py"] == "" and got["src/app/free/y.py"] == "src/app/free"


@pytest.mark.parametrize("name,terms", [("HTTPServerError", "http server error"), ("getUserID2", "get user id2"), ("snake_case.value", "snake case value"), ("", "")])
def test_identifier_terms(spark, name, terms):
    assert one(spark, text.normalize_identifier(F.col("n")), n=name) == terms


@pytest.mark.parametrize("quoted,bare", [("'a'", "a"), ('"a b"', "a b"), ("'a\"", "'a\""), ("a", "a"), ("''", ""), ("'", "'")])
def test_quotes(spark, quoted, bare):
    assert one(spark, text.strip_quotes(F.col("q")), q=quoted) == bare


@pytest.mark.parametrize("body,place", [("x.name()", 2), ("name name", None), ("rename", None), ("$name", None), ("é name", 2)])
def test_sole_identifier(spark, body, place):
    assert one(spark, text.sole_position(F.col("b"), F.lit("name")), b=body) == place


@pytest.mark.parametrize("name,language,valid", [("ok", "python", True), ("class", "python", False), ("é", "python", True), ("é", "typescript", False), ("$x", "javascript", True), ("1x", "tsx", False), ("", "python", False)])
def test_identifiers(name, language, valid):
    assert text.is_identifier(name, language) is valid


def test_numbers(spark):
    assert one(spark, scalars.token_budget(F.col("m")), m=0) == 1024
    assert one(spark, scalars.token_budget(F.col("m")), m=2 << 30) == 4096
    assert one(spark, scalars.token_budget(F.col("m")), m=1 << 40) == 32768
    assert one(spark, scalars.crossover(F.lit(10.0), F.lit(2.0), F.lit(1.0))) is None
    assert one(spark, scalars.crossover(F.lit(10.0), F.lit(1.0), F.lit(2.0))) == 20.0
    assert one(spark, scalars.rate_per_second(F.lit(3), F.lit(0))) is None
    assert one(spark, scalars.gate(F.lit(None).cast("double"), 0.5)) is False
    assert one(spark, scalars.length_bucket(F.lit(1024))) == 11
    assert one(spark, scalars.memory_ceiling(F.lit(5), F.lit(3))) == 0


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    row = spark.range(1).select(vectors.norm(a), vectors.cosine(a, a), vectors.cosine(a, b), vectors.normalized(a), vectors.masked_mean(F.array(a, b, a), F.array(F.lit(1), F.lit(0), F.lit(1)))).first()
    assert row[0] == 5 and row[1] == pytest.approx(1) and row[2] is None and list(row[3]) == [0.6, 0.8] and list(row[4]) == pytest.approx([0.6, 0.8])
    import numpy as np

    df = spark.createDataFrame([([0.1, 0.2],), (None,), ([],)], "v array<float>")
    got = [r[0] for r in df.select(vectors.half_precision(F.col("v"))).collect()]
    assert got[0] == [float(np.float16(x)) for x in (0.1, 0.2)] and got[1] is None and got[2] == []
