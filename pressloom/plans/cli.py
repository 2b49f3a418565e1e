"""Command line: ``python -m pressloom.plans.cli COMMAND``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..functions.lexicon import Lexicon
from ..operators import sampling
from ..sources import config as K
from ..sources import tables
from . import stages
from .windows import Window, label, windows


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pressloom")
    p.add_argument("--root", default=".", help="folder or address of the data")
    p.add_argument("--lexicon", action="append", default=[], help="YAML file; repeat to merge; the built-in example without one")
    sub = p.add_subparsers(dest="command", required=True)
    one = {}
    for name in stages.STAGES:
        one[name] = s = sub.add_parser(name)
        s.add_argument("--run-id", default="")
        s.add_argument("--config")
        s.add_argument("--from-date")
        s.add_argument("--to-date")
        s.add_argument("--sleep-seconds", type=float, default=3.0 if name == "retry" else 1.0)
    run = sub.add_parser("pipeline")
    run.add_argument("--mode", choices=("monthly", "yearly"), default="monthly")
    for flag in ("--start-year", "--end-year"):
        run.add_argument(flag, type=int, required=True)
    for flag in ("--start-month", "--end-month"):
        run.add_argument(flag, type=int, choices=range(1, 13))
    run.add_argument("--config", required=True)
    run.add_argument("--sleep-seconds", type=float, default=2.0)
    for flag in ("--skip-retry", "--continue-on-error", "--force", "--only-summary"):
        run.add_argument(flag, action="store_true")
    for name in ("yearly", "contextual"):
        s = sub.add_parser(name)
        s.add_argument("--start-year", type=int, default=2015)
        s.add_argument("--end-year", type=int, default=2025)
        if name == "contextual":
            s.add_argument("--max-excerpt-chars", type=int, default=600)
    s = sub.add_parser("sample")
    s.add_argument("--input")
    s.add_argument("--output-dir")
    s.add_argument("--seed", type=int, default=sampling.SEED)
    for group, n in sampling.SIZES.items():
        s.add_argument(f"--{group.replace('_', '-')}-size", type=int, default=n)
    s = sub.add_parser("evaluate")
    s.add_argument("--input", required=True)
    s.add_argument("--output-dir", required=True)
    s = sub.add_parser("corpus")
    s.add_argument("--decisions")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("pressloom").getOrCreate()
    lexicon = Lexicon.from_yaml(*a.lexicon) if a.lexicon else Lexicon.default()
    if a.command in stages.STAGES:
        found = K.load_yaml(K.resolve(a.config, a.root)) if a.config else {}
        window = Window(K.run_id(a.run_id) or "", a.from_date or str(found.get("from_date", "")), a.to_date or str(found.get("to_date", "")))
        stages.run_stage(spark, a.command, K.RunPaths(a.root, window.run_id or None), window, found, lexicon, sleep=a.sleep_seconds)
    elif a.command == "pipeline":
        found = K.load_yaml(K.resolve(a.config, a.root))
        span = (a.mode, a.start_year, a.end_year, a.start_month, a.end_month)
        if not a.only_summary:
            stages.collect(spark, a.root, windows(*span), found, lexicon, sleep=a.sleep_seconds, retry=not a.skip_retry, force=a.force, go_on=a.continue_on_error)
        print(stages.pipeline_report(spark, a.root, windows(*span), found, label(*span)))
    elif a.command == "yearly":
        stages.yearly_tables(spark, a.root, a.start_year, a.end_year)
    elif a.command == "contextual":
        stages.contextual_reports(spark, a.root, lexicon, a.start_year, a.end_year, a.max_excerpt_chars)
    elif a.command == "sample":
        sizes = {g: getattr(a, f"{g}_size") for g in sampling.SIZES}
        stages.validation_sample(spark, tables.parquet(spark, a.input or f"{a.root}/outputs/reports/articles_contextual_unique.parquet"), a.output_dir or f"{a.root}/outputs/validation", sizes, a.seed)
    elif a.command == "evaluate":
        stages.evaluate(spark, tables.csv(spark, a.input), a.output_dir)
    elif a.command == "corpus":
        stages.final_corpus(spark, a.root, tables.csv(spark, a.decisions) if a.decisions else None)


if __name__ == "__main__":
    main()
