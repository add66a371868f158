"""Command line: `python -m textloom index | search | map | status | export`."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from textloom.engine import Engine, index_dir


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textloom")
    top.add_argument("command", choices=("index", "search", "map", "status", "export"))
    top.add_argument("query", nargs="?", default="")
    top.add_argument("--workspace", default=".")
    top.add_argument("--index-dir")
    top.add_argument("--paths", nargs="+")
    top.add_argument("--full", action="store_true")
    top.add_argument("--dry-run", action="store_true")
    top.add_argument("--top-k", type=int, default=5)
    top.add_argument("--quiet", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    given = parser().parse_args(argv)
    spark = SparkSession.builder.appName("textloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder, _ = index_dir(given.index_dir, given.workspace)
    engine = Engine(spark, folder)
    tell = None if given.quiet else lambda phase, percent: print(f"{percent:3d}% {phase}", file=sys.stderr)
    if given.command == "index":
        told = engine.index(given.workspace, given.paths, given.full, given.dry_run, progress=tell)
    elif given.command == "search":
        told = engine.search(given.query, given.top_k)
    elif given.command == "status":
        told = engine.status(given.workspace)
    elif given.command == "export":
        told = engine.export_graph(folder)
    else:
        told = engine.symbol_map()
    print(told if isinstance(told, str) else json.dumps(told, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
