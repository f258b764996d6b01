"""Command line: train, score and explain a gated model, check typed reports.

    python -m marlow train --config FILE --queries PATH --labels PATH --state PATH [--set NAME=VALUE ...]
    python -m marlow score --config FILE --queries PATH --labels PATH --state PATH --output PATH
    python -m marlow explain ... --output PATH [--num-steps N]
    python -m marlow check --typed-txt PATH --out-check PATH --out-per-pat PATH

Tables are Parquet: vectors (subject_id, vec_id, days, vector) as the configuration names them, queries (modality, query_idx, vector), labels (subject_id, label, part).
The session is the caller's, as spark-submit sets it up.
"""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from marlow.functions import parsing
from marlow.operators import gating, training
from marlow.sources import config, io
from marlow.sources.reports import read_reports


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="marlow")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("train", "score", "explain"):
        p = commands.add_parser(name)
        for x in ("--config", "--queries", "--labels", "--state"):
            p.add_argument(x, required=True)
        p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
        if name != "train":
            p.add_argument("--output", required=True)
    commands.choices["explain"].add_argument("--num-steps", type=int, default=50)
    p = commands.add_parser("check")
    for x in ("--typed-txt", "--out-check", "--out-per-pat"):
        p.add_argument(x, required=True)
    return parser


def check(spark: SparkSession, typed: str, out_check: str, out_blocks: str) -> None:
    """The reports of a concatenated file: one document of all by subject, and a record of each one's failures."""
    rows = read_reports(spark, typed).groupBy(F.col("subject_id").cast("long").alias("subject_id")).agg(F.max_by("block", F.struct("path", "start")).alias("report"))
    io.write_document(rows, out_blocks, key="subject_id")
    issues = parsing.typed_issues(F.col("subject_id"), F.col("report"))
    io.write_jsonl(rows.select(F.col("subject_id").alias("sid"), issues.alias("failures")).withColumn("format_pass", F.size("failures") == 0).orderBy("sid"), out_check)


def model(spark: SparkSession, args: argparse.Namespace) -> None:
    changes = {k: config.value(v) for k, v in (x.split("=", 1) for x in args.set)}
    settings = config.load(spark, args.config, **changes)
    notes, codes, labels = (spark.read.parquet(p) for p in (settings.note_parquet, settings.code_parquet, args.labels))
    rows = gating.ordered(spark.read.parquet(args.queries))
    start = settings.model(np.array([r["vector"] for r in rows], float))
    if args.command == "train":
        training.fit(notes, codes, labels, start, settings.plan(labels.where("part = 'train'").count()), args.state)
        return
    trained = training.restored(spark, args.state, start)
    fixed = training.inputs(notes, codes, labels)
    if args.command == "score":
        io.write_jsonl(training.predicted(notes, codes, fixed, trained, settings.k_retrieval).withColumnRenamed("p", "probability"), args.output)
    else:
        training.explained(notes, codes, fixed, trained, settings.k_retrieval, args.num_steps).write.mode("overwrite").parquet(args.output)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("marlow").getOrCreate()
    if args.command == "check":
        check(spark, args.typed_txt, args.out_check, args.out_per_pat)
    else:
        model(spark, args)


if __name__ == "__main__":
    main()
