"""Command line: ``python -m loomseek.cli --root DIR COMMAND ...``; JSON on standard output."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from loomseek import evaluate
from loomseek.engine import DEFAULT_LIMIT, MODES, Engine

NAVIGATION = ("definitions", "references", "imports", "calls", "callers")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomseek", description=__doc__)
    p.add_argument("--root", default=".")
    p.add_argument("--home", default=os.environ.get("LOOMSEEK_HOME"), help="folder of the index; on a cluster one that all machines share")
    p.add_argument("--ignore-file", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("index")
    sub.add_parser("status")
    sub.add_parser("sync").add_argument("paths", nargs="*")
    search = sub.add_parser("search")
    search.add_argument("query", nargs="?", default="")
    search.add_argument("--mode", choices=MODES, default="auto")
    search.add_argument("--context", help="JSON file of an editor's context")
    read = sub.add_parser("read")
    read.add_argument("file")
    read.add_argument("start", type=int, nargs="?", default=1)
    read.add_argument("end", type=int, nargs="?")
    check = sub.add_parser("evaluate")
    check.add_argument("labels")
    check.add_argument("--report")
    check.add_argument("--sealed", action="store_true")
    for name in ("symbol", "regex", *NAVIGATION):
        sub.add_parser(name).add_argument("query", nargs="?", default="")
    for name in ("search", "symbol", "regex", *NAVIGATION):
        one = sub.choices[name]
        one.add_argument("--limit", type=int, default=DEFAULT_LIMIT)
        one.add_argument("--path")
        one.add_argument("--include-docs", action="store_true")
        if name in NAVIGATION:
            one.add_argument("--file")
            one.add_argument("--line", type=int)
            one.add_argument("--column", type=int, default=0)
    return p


def answer(engine: Engine, args: argparse.Namespace) -> object:
    """What a command prints."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if args.command == "index":
        return engine.refresh()
    if args.command == "sync":
        return engine.refresh(args.paths or None)
    if args.command == "status":
        return engine.status()
    engine.refresh()
    if args.command == "read":
        return rows(engine.read(args.file, args.start, args.end))
    if args.command == "evaluate":
        return evaluate.run(engine, args.labels, args.report, args.sealed)
    context = json.load(open(args.context)) if getattr(args, "context", None) else None
    place = {k: getattr(args, k) for k in ("file", "line", "column") if hasattr(args, k)}
    mode = args.mode if args.command == "search" else args.command
    found = engine.query(args.query, mode, args.limit, args.path, args.include_docs, context, **place)
    return {"route": {"mode": found.mode, "reason": found.reason}, "results": rows(found.results), "generation": found.generation, "elapsed_ms": round(found.elapsed_ms, 1)}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("loomseek").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not args.home and not spark.sparkContext.master.startswith("local"):
        print(json.dumps({"error": "--home must name a folder that all machines share"}), file=sys.stderr)
        return 1
    home = args.home or f"file://{os.path.expanduser('~')}/.cache/loomseek"
    engine = Engine(spark, home, args.root, **({"ignore_file": args.ignore_file} if args.ignore_file else {}))
    try:
        print(json.dumps(answer(engine, args), default=str, ensure_ascii=False))
        return 0
    except (ValueError, LookupError, RuntimeError) as error:
        print(json.dumps({"error": str(error)}), file=sys.stderr)
        return 1
    finally:
        engine.close()


if __name__ == "__main__":
    sys.exit(main())
