"""Command line: python -m tagloom build|evaluate|compare|errors|checkpoints ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from tagloom.plans import pipelines
from tagloom.plans.storage import workspace
from tagloom.sources import records as io


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tagloom", description=__doc__)
    steps = parser.add_subparsers(dest="step", required=True)
    build = steps.add_parser("build", help="annotated files to splits and instruction records")
    build.add_argument("corpus", help="pattern of the annotated files")
    build.add_argument("out")
    build.add_argument("--seed", type=int, default=42)
    evaluate = steps.add_parser("evaluate", help="measures of a result document with predictions")
    evaluate.add_argument("result")
    evaluate.add_argument("--iterations", type=int, default=1000)
    evaluate.add_argument("--out")
    for name, text in (("compare", "paired difference of two result documents"), ("errors", "error tables of two result documents")):
        two = steps.add_parser(name, help=text)
        two.add_argument("a")
        two.add_argument("b")
    steps.choices["compare"].add_argument("--unit", default="publication")
    steps.choices["compare"].add_argument("--iterations", type=int, default=1000)
    steps.choices["errors"].add_argument("--by", default="act", choices=["act", "entity_type"])
    chosen = steps.add_parser("checkpoints", help="best candidate step of each run of a CSV file run,step,dev_f1")
    chosen.add_argument("listing")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("tagloom").getOrCreate()
    with workspace(spark):
        run(spark, args)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """One step; its result is printed or written before the intermediate tables go."""
    if args.step == "build":
        print(json.dumps(pipelines.build_dataset(spark, args.corpus, args.out, args.seed), ensure_ascii=False, indent=2))
    elif args.step == "evaluate":
        head = io.read_results(spark, args.result).select("model", "split").first()
        made = pipelines.evaluate(pipelines.load_predictions(spark, args.result), head["model"], head["split"], args.iterations)
        if args.out:
            io.write_report(made, args.out)
        print(json.dumps(made["metrics"] | {"bootstrap": made["bootstrap"]}, ensure_ascii=False, indent=2))
    elif args.step == "compare":
        a, b = (pipelines.load_predictions(spark, p) for p in (args.a, args.b))
        print(json.dumps(pipelines.compare(a, b, args.unit, args.iterations), ensure_ascii=False, indent=2))
    elif args.step == "errors":
        a, b = (pipelines.load_predictions(spark, p) for p in (args.a, args.b))
        for df in pipelines.error_tables(a, b, args.by):
            print(io.console(df))
    else:
        listing = spark.read.schema("run string, step bigint, dev_f1 double").option("header", "true").csv(args.listing)
        print(io.console(pipelines.choose_checkpoints(listing)))


if __name__ == "__main__":
    main()
