"""Command line: ``python -m strataquery --data FOLDER verb …``; results are printed as JSON."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from strataquery.errors import EngineError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strataquery", description=__doc__)
    top.add_argument("--data", required=True, help="folder of the registry and the indexes")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(word: str, /, *arguments: str, **options) -> argparse.ArgumentParser:
        own = verbs.add_parser(word)
        for a in arguments:
            own.add_argument(a)
        for flag, more in options.items():
            own.add_argument(f"--{flag.replace('_', '-')}", **more)
        return own

    verb("init", "path", name={}, force_new_id={"action": "store_true"}, allow_overlap={"action": "store_true"})
    verb("index", "project", force={"action": "store_true"})
    verb("status", "project")
    verb("history", "project", limit={"type": int, "default": 20}, cursor={})
    verb("scan", "project", status={"action": "append", "default": []}, offset={"type": int, "default": 0}, limit={"type": int, "default": 100})
    verb("projects")
    verb("remove", "project")
    verb("storage")
    verb("vacuum", project={}, keep_hours={"type": float})
    verb("search", "query", project={"action": "append", "default": []}, language={"action": "append", "default": []}, path={"action": "append", "default": []}, kind={"action": "append", "default": []}, limit={"type": int, "default": 8})
    verb("symbol", "name", "project", match={"default": "exact", "choices": ["exact", "prefix", "contains"]}, limit={"type": int, "default": 20})
    verb("outline", "path", "project")
    verb("chunk", "id")
    verb("references", "project", "path", "symbol", limit={"type": int, "default": 50}, cursor={})
    verb("rename", "project", "path", "symbol", "new_name")
    return top


def run(engine, a: argparse.Namespace):
    calls = {
        "init": lambda: engine.init_project(a.path, a.name, a.force_new_id, a.allow_overlap),
        "index": lambda: engine.index_project(a.project, a.force),
        "status": lambda: engine.project_status(a.project),
        "history": lambda: engine.index_history(a.project, a.limit, a.cursor),
        "scan": lambda: engine.inspect_scan(a.project, a.status, a.offset, a.limit),
        "projects": lambda: engine.list_projects(),
        "remove": lambda: engine.remove_project(a.project),
        "storage": lambda: engine.index_storage_status(),
        "vacuum": lambda: engine.index_storage_maintenance(a.project, a.keep_hours),
        "search": lambda: engine.search_code(a.query, a.project, languages=a.language, paths_like=a.path, kinds=a.kind, limit=a.limit),
        "symbol": lambda: engine.find_symbol(a.name, a.project, match=a.match, limit=a.limit),
        "outline": lambda: engine.file_outline(a.path, a.project),
        "chunk": lambda: engine.get_chunk(a.id),
        "references": lambda: engine.find_references(a.project, path=a.path, symbol=a.symbol, limit=a.limit, cursor=a.cursor),
        "rename": lambda: engine.analyze_refactor(a.project, {"rename": a.new_name}, path=a.path, symbol=a.symbol),
    }
    return calls[a.verb]()


def plain(value):
    if dataclasses.is_dataclass(value):
        return dataclasses.asdict(value)
    return str(value)


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    from pyspark.sql import SparkSession

    from strataquery.engine import Engine

    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        print(json.dumps(run(Engine(spark, a.data), a), default=plain, indent=1))
    except EngineError as error:
        print(json.dumps({"code": error.code, "message": str(error), "details": error.details}, default=plain), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
