"""Command line: ``python -m quakeloom <command>`` on an existing session.

Snapshots are read from a folder; fetching them is left to other tools.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quakeloom.fixed_values import GRID_HORIZONS, GRID_THRESHOLDS
from quakeloom.operators.replay import walk_forward_grid
from quakeloom.operators.summaries import counts_by, source_pipeline_status
from quakeloom.operators.validation import summarise_backtest_grid
from quakeloom.plans import pipelines, report
from quakeloom.session import staging, use_utc
from quakeloom.sources import bronze, fdsn, tables


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="quakeloom")
    main.add_argument("--bronze", default="data/bronze")
    main.add_argument("--silver", default="data/silver/events")
    main.add_argument("--gold", default="data/gold/fingerprints")
    sub = main.add_subparsers(dest="command", required=True)
    for name in ("bootstrap-demo", "build-silver", "data-status", "isc-diagnostics", "clean-derived"):
        sub.add_parser(name)
    gold = sub.add_parser("build-gold")
    gold.add_argument("--catalogue-mode", choices=pipelines.MODES)
    gold.add_argument("--magnitude-policy", choices=pipelines.POLICIES)
    for name in ("report", "run-all"):
        text = sub.add_parser(name)
        text.add_argument("--output", default="latest_report.md")
        text.add_argument("--tables", default="data/gold/report")
        text.add_argument("--rows", type=int, default=100, help="rows of a table in the Markdown view")
    grid = sub.add_parser("validate-grid")
    grid.add_argument("--domain")
    grid.add_argument("--window-days", type=int, default=90)
    grid.add_argument("--frequency-days", type=int, default=60)
    grid.add_argument("--output", default="data/gold/validation")
    return main


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = use_utc(SparkSession.builder.appName("quakeloom").getOrCreate())
    with staging(spark):  # every command writes or shows its result
        run(spark, args)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "bootstrap-demo":
        pipelines.bootstrap_demo(spark, args.silver, args.gold)
    if args.command in ("build-silver", "run-all"):
        pipelines.build_silver(spark, args.bronze, args.silver)
    if args.command == "run-all":
        pipelines.build_gold(tables.load_silver(spark, args.silver), args.gold)
    if args.command == "build-gold":
        snapshots = bronze.read_snapshots(spark, args.bronze)
        events = tables.assert_not_stale_demo(
            tables.load_silver(spark, args.silver), _exists(spark, args.bronze) and not snapshots.isEmpty()
        )
        pipelines.build_gold(
            events, args.gold,
            [args.catalogue_mode] if args.catalogue_mode else pipelines.MODES,
            [args.magnitude_policy] if args.magnitude_policy else pipelines.POLICIES,
        )
    if args.command in ("report", "run-all"):
        events, states = tables.load_silver(spark, args.silver), tables.load_gold(spark, args.gold)
        report.write_report(events, states, args.tables)
        with open(args.output, "w", encoding="utf-8") as handle:
            handle.write(report.markdown_report(events, states, args.rows))
    if args.command == "data-status":
        events = tables.load_silver(spark, args.silver)
        source_pipeline_status(
            events, bronze.snapshot_counts(bronze.read_snapshots(spark, args.bronze))
        ).show(truncate=False)
        counts_by(events, "tectonic_domain").show(truncate=False)
    if args.command == "isc-diagnostics":
        fdsn.diagnose(bronze.read_snapshots(spark, f"{args.bronze}/isc"), 1000).show(truncate=80)
    if args.command == "validate-grid":
        scores = walk_forward_grid(
            tables.load_silver(spark, args.silver), tables.load_gold(spark, args.gold),
            args.window_days, GRID_THRESHOLDS, GRID_HORIZONS, args.frequency_days, domain=args.domain,
        )
        tables.save(scores, f"{args.output}/scores")
        stored = spark.read.parquet(f"{args.output}/scores")
        tables.save(summarise_backtest_grid(stored), f"{args.output}/summary")
    if args.command == "clean-derived":
        for path in (args.silver, f"{args.silver}.metadata", args.gold):
            _delete(spark, path)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    system, target = _filesystem(spark, path)
    return system.exists(target)


def _delete(spark: SparkSession, path: str) -> None:
    system, target = _filesystem(spark, path)
    system.delete(target, True)


if __name__ == "__main__":
    main()
