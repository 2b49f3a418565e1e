"""Calendar windows: days, and the months or years that runs are made of."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Window:
    run_id: str
    from_date: str
    to_date: str


def windows(mode: str, start_year: int, end_year: int, start_month: int | None = None, end_month: int | None = None) -> list[Window]:
    """Years, or months from the first year's ``start_month`` to the last year's ``end_month``."""
    if mode == "yearly":
        return [Window(f"{y}", f"{y}0101", f"{y}1231") for y in range(start_year, end_year + 1)]
    if mode != "monthly":
        raise ValueError(f"mode {mode!r} is neither monthly nor yearly")
    first, last = 12 * start_year + (start_month or 1) - 1, 12 * end_year + (end_month or 12) - 1
    out = []
    for k in range(first, last + 1):
        y, m = divmod(k, 12)
        end = date(y + (m == 11), (m + 1) % 12 + 1, 1) - timedelta(1)
        out.append(Window(f"{y}_{m + 1:02d}", f"{y}{m + 1:02d}01", end.strftime("%Y%m%d")))
    return out


def label(mode: str, start_year: int, end_year: int, start_month: int | None = None, end_month: int | None = None) -> str:
    months = f"_{start_month or 1:02d}_{end_month or 12:02d}" if start_month or end_month else ""
    return f"{mode}_{start_year}_{end_year}{months}"


def _dates(spark: SparkSession, first: str, last: str, step: str) -> DataFrame:
    d = lambda s: F.to_date(F.lit(s), "yyyyMMdd")
    return spark.range(1).select(F.explode(F.sequence(d(first), d(last), F.expr(f"interval 1 {step}"))).alias("d"))


def day_table(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(query_day): all days from one ``YYYYMMDD`` to another."""
    return _dates(spark, first, last, "day").select(F.date_format("d", "yyyyMMdd").alias("query_day"))


def month_table(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(run_id, from_date, to_date) of the months from one first day to another."""
    return _dates(spark, first, last, "month").select(F.date_format("d", "yyyy_MM").alias("run_id"), F.date_format("d", "yyyyMMdd").alias("from_date"), F.date_format(F.last_day("d"), "yyyyMMdd").alias("to_date"))


def query_grid(sources: DataFrame, days: DataFrame) -> DataFrame:
    """Every source on every day: what the index is asked for. Both sides are configurations."""
    return sources.crossJoin(F.broadcast(days))
