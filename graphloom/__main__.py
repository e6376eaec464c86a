"""Command lines: python -m graphloom build|rebuild|plan|tool ..., over tables in a folder."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from graphloom.operators.hooks import pass_plan
from graphloom.service import CodeGraph
from graphloom.sources import files


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="graphloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("build", "rebuild", "plan"):
        c = commands.add_parser(name)
        c.add_argument("root")
        c.add_argument("project")
        c.add_argument("tables")
        c.add_argument("--base", default="HEAD~1", help="what changed files are told from")
    c = commands.add_parser("tool")
    c.add_argument("tables")
    c.add_argument("name")
    c.add_argument("given", nargs="*", help="key=value")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if a.command == "tool":
        given = {k: int(v) if v.lstrip("-").isdigit() else v for k, _, v in (x.partition("=") for x in a.given)}
        print(json.dumps(CodeGraph.load(spark, a.tables).tool(a.name, **given), default=str))
    elif a.command == "plan":
        paths = [(p,) for p in files.tracked_files(a.root)]
        print(json.dumps(pass_plan(spark.createDataFrame(paths, "path string")).first().asDict()))
    else:
        # An incremental build goes to a folder beside the one it reads.
        old = CodeGraph.load(spark, a.tables) if a.command == "rebuild" else None
        made = old.rebuild(a.root, a.project, files.changed_files(a.root, a.base)) if old else CodeGraph.build(spark, a.root, a.project)
        made.save(a.tables if old is None else a.tables.rstrip("/") + ".new")
        print(made.context(a.project))


if __name__ == "__main__":
    main()
