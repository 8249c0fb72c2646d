"""``python -m vetloom extract|evaluate``: reports over tables of tokens.

``extract INPUT OUT`` writes a report or JSON of each document to a folder.
INPUT is a table of tokens, or with ``--recogniser MODULE:FACTORY`` an uploaded
file or a folder of them (see :mod:`vetloom.sources.files`).  The exit code is 0
if every document was read, 1 if INPUT is missing or a document failed, and 2
after an error.  ``evaluate TOKENS TRUTH`` compares with labelled files
(``pan_ground_truth.json`` and so on, of which any may be missing or have broken
records, with a warning) and prints the metrics of the eleven fields.  A labelled file name
matches a document whose id ends with it.  The exit code is 0, or 2 after an
error.  Without a command there is help, and 0.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetloom.operators import evaluate, extract
from vetloom.session import checkpointed, exists, ship
from vetloom.sources import files, sinks

VERSION = "0.1.0"


def _results(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if not args.recogniser:
        return extract.results(files.tokens(spark, args.input))
    module, _, name = args.recogniser.partition(":")
    taken, refused = files.uploads(spark, args.input)
    tokens, failures = files.recognised(taken, getattr(importlib.import_module(module), name))
    return extract.results(tokens, failures.unionByName(refused.withColumnRenamed("path", "doc_id")))


def _extract(spark: SparkSession, args: argparse.Namespace) -> int:
    if not exists(spark, args.input):
        print(f"Error: no input {args.input}", file=sys.stderr)
        return 1
    done = checkpointed(_results(spark, args))
    if args.output == "json":
        sinks.as_json(done).select("json").write.mode("overwrite").text(args.out)
    else:
        sinks.result_lines(done).repartition("doc_id").sortWithinPartitions("doc_id", "line_no").select("line").write.mode("overwrite").text(args.out)
    return int(not done.filter("status <> 'success'").isEmpty())


def _predictions(spark: SparkSession, tokens: str) -> DataFrame:
    rows = extract.results(files.tokens(spark, tokens)).select(F.regexp_extract("doc_id", r"([^/]*)$", 1).alias("file"), F.explode_outer("fields").alias("field", "hit"))
    return rows.select("file", "field", F.col("hit.value").alias("value")).filter("field is not null")


def _evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    kinds = ["pan", "gst", "bank"] if args.doc_type == "all" else [args.doc_type]
    truth = None
    for kind in kinds:
        path = f"{args.truth.rstrip('/')}/{kind}_ground_truth.json"
        if not exists(spark, path):
            print(f"Warning: no labelled file {path}", file=sys.stderr)
            continue
        known, broken = files.labelled_apart(spark, path, kind)
        if n := broken.count():
            print(f"Warning: {n} broken records in {path}", file=sys.stderr)
        rows = evaluate.unpivoted(known, kind)
        truth = rows if truth is None else truth.unionByName(rows)
    if truth is None:
        print("[]" if args.output == "json" else "Nothing to evaluate")
        return 0
    metrics = evaluate.metrics(evaluate.counts(truth, _predictions(spark, args.tokens))).orderBy("doc_type", "gt_key")
    if args.output == "json":
        print(json.dumps([r.asDict() for r in metrics.collect()], indent=2))  # eleven rows at most
    else:
        for r in sinks.metric_lines(metrics).collect():
            print(f"{r.doc_type} {r.gt_key}: {r.line}")
        told = evaluate.summary(metrics).first()
        print("Nothing to evaluate" if told.pass_rate is None else f"Fields at the target: {told.passing_fields}/{told.total_fields} ({told.pass_rate:.1%}) - {told.verdict}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vetloom")
    parser.add_argument("--version", action="version", version=VERSION)
    commands = parser.add_subparsers(dest="command")
    one = commands.add_parser("extract")
    one.add_argument("input")
    one.add_argument("out")
    one.add_argument("--recogniser", help="module:factory of the recogniser of uploaded files")
    two = commands.add_parser("evaluate")
    two.add_argument("tokens")
    two.add_argument("truth")
    two.add_argument("--doc-type", choices=["pan", "gst", "bank", "all"], default="all")
    for command, run in ((one, _extract), (two, _evaluate)):
        command.add_argument("--output", choices=["text", "json"], default="text")
        command.set_defaults(run=run)
    args = parser.parse_args(argv)
    if args.command is None:
        parser.print_help()
        return 0
    try:
        return args.run(ship(SparkSession.builder.getOrCreate()), args)
    except Exception as error:  # a command line tells what went wrong and ends
        print(f"Error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
