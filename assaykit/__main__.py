"""Command line: python -m assaykit dimensions | score PATH | report PATH --out FILE

score and report take --dimensions a,b, --scope project|changes|worktree|task with --ref or --task, --packs a,b
for optional units, and score --out DIR for ratings and --evidence DIR for the evidence packs, both written
only where nothing is yet."""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="assaykit")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("dimensions")
    for name in ("score", "report"):
        p = commands.add_parser(name)
        p.add_argument("path")
        p.add_argument("--dimensions")
        p.add_argument("--out", required=name == "report")
        p.add_argument("--scope", default="project")
        p.add_argument("--ref")
        p.add_argument("--task")
        p.add_argument("--packs", default="")
        p.add_argument("--evidence")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from assaykit.operators import packs
    from assaykit.plans import dimensions, evaluate
    from assaykit.sources import corpus

    spark = SparkSession.builder.appName("assaykit").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if args.command == "dimensions":
        print(json.dumps([r.asDict() for r in dimensions.discover(spark).collect()], indent=2))
        return 0
    names = args.dimensions.split(",") if args.dimensions else None
    found = evaluate.evaluate(spark, args.path, args.scope, args.ref, args.task, names, tuple(filter(None, args.packs.split(","))))
    result = found.score
    if args.evidence:
        packs.write(found.packs, args.evidence)
    if args.command == "report":
        corpus.write_report("Evaluation", {"overall": result.overall, "ratings": result.ratings, "plan": result.plan, "gates": result.gates}, args.out)
        return 0
    if args.out:
        corpus.write_json(result.ratings, args.out)
    summary = {k: [r.asDict() for r in getattr(result, k).collect()] for k in ("overall", "ratings", "plan", "gates")}
    print(json.dumps({"schema_version": 1} | summary, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
