"""Command line: analyze a pipeline, compare two versions, serve tools over standard input."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .export import dot
from .govern.diff import PipelineDiff
from .lineage import Pipeline
from .tools import create_registry, server


def load(spark: SparkSession, path: str, dialect: str = "spark") -> Pipeline:
    """A folder of SQL files, a script, or an exported pipeline."""
    p = Path(path)
    if p.is_dir():
        return Pipeline.from_sql_files(spark, path, dialect=dialect)
    if p.suffix == ".json":
        return Pipeline.from_json_file(spark, path)
    return Pipeline.from_sql_string(spark, p.read_text(), dialect=dialect)


def _table_text(p: Pipeline) -> str:
    out = [f"{len(p.queries)} statements, {len(p.tables)} tables, {len(p.graph.nodes)} columns, {len(p.graph.edges)} edges, {len(p.graph.issues)} issues", ""]
    width = max([5, *(len(t) for t in p.tables)])
    out += [f"{'table':<{width}}  role          columns", *(f"{t.name:<{width}}  {t.role:<12}  {len(t.columns)}" for t in p.tables.values())]
    out += ["", *(f"{i.severity}: {i.message} [{i.query_id}]" for i in p.graph.issues)]
    return "\n".join(out)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("path")
    a.add_argument("--format", choices=("table", "json", "dot"), default="table")
    a.add_argument("--dialect", default="spark")
    d = sub.add_parser("diff")
    d.add_argument("old")
    d.add_argument("new")
    d.add_argument("--format", choices=("table", "json"), default="table")
    d.add_argument("--dialect", default="spark")
    s = sub.add_parser("serve")
    s.add_argument("path")
    s.add_argument("--dialect", default="spark")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    if args.command == "analyze":
        p = load(spark, args.path, args.dialect)
        print({"table": lambda: _table_text(p), "json": lambda: json.dumps(p.to_json(), default=str), "dot": lambda: dot.table_dependencies(p, True)}[args.format]())
        return int(p.has_errors())
    if args.command == "diff":
        found = PipelineDiff(load(spark, args.new, args.dialect), load(spark, args.old, args.dialect))
        print(found.summary() if args.format == "table" else json.dumps([c.__dict__ for c in found.changes()]))
        return int(found.has_changes)
    registry = create_registry(load(spark, args.path, args.dialect))
    for line in sys.stdin:
        request = json.loads(line)
        if "jsonrpc" in request:
            server.serve(registry, [line])
            continue
        print(server.call_tool(registry, request["tool"], request.get("arguments", {})), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
