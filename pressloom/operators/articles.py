"""Keys, years, categories and deduplication of classified articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

URLS = ("normalized_url", "candidate_url", "original_url", "url")
BODIES = ("text_clean", "text", "text_raw")
# Ranks of statuses, review priorities and main categories.
STATUS_RANK = {"not_selected": 0, "topic_explicit_not_case": 1, "review_ambiguous_case": 2, "review_contextual_medium": 3, "candidate_contextual_high": 4, "candidate_explicit_case": 5}
PRIORITY_RANK = {"P0_explicit_sample_only": 0, "P1_contextual_high": 1, "P2_contextual_medium": 2, "P3_ambiguous_case": 3, "P4_not_selected": 4}
CATEGORY_PRIORITY = {"other": 0, "not_candidate": 1, "topic": 2, "case_review": 3, "case_strong": 4}


def existing(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in names if c in df.columns]


def first_of(df: DataFrame, names: Sequence[str]) -> Column:
    """The first column, of those there, that is not blank; trimmed, else empty."""
    return X.first_nonblank(*[F.col(c) for c in existing(df, names)])


def trimmed(df: DataFrame, name: str) -> Column:
    return first_of(df, (name,))


def ranked(value: Column, ranks: dict[str, int], otherwise: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), value), F.lit(otherwise))


def archive_year(df: DataFrame) -> Column:
    """From the timestamp, else from the run's name, else null."""
    year = lambda c: F.nullif(F.regexp_extract(F.col(c).cast("string"), "^([0-9]{4})", 1), F.lit(""))
    return F.coalesce(*[year(c) for c in existing(df, ("snapshot_timestamp", "run_id"))], F.lit(None).cast("string")).cast("int")


def snapshot_datetime(timestamp: Column) -> Column:
    digits = F.regexp_extract(X.blank(timestamp.cast("string")), "^([0-9]{14})", 1)
    return F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def with_article_key(df: DataFrame, row: str | None = None, urls: Sequence[str] = URLS) -> DataFrame:
    """Adds ``_article_url`` and ``_article_key``: country, source and address, or run and row where there is no address.

    ``row`` is a column that names a row within its run; without one, the place
    in the scan does, so this belongs before any shuffle.
    """
    place = F.col(row).cast("string") if row else F.monotonically_increasing_id().cast("string")
    run = F.col("run_id").cast("string") if "run_id" in df.columns else F.lit("")
    df = df.withColumn("_article_url", first_of(df, urls))
    known = F.concat_ws("|", trimmed(df, "country"), trimmed(df, "source"), F.col("_article_url"))
    return df.withColumn("_article_key", F.when(F.col("_article_url") == "", F.concat_ws("|", run, F.lit("row"), place)).otherwise(known))


def decision_key(df: DataFrame) -> Column:
    """The address, or source, year and title: what manual decisions are joined by."""
    title = trimmed(df, "title_clean" if "title_clean" in df.columns else "title")
    url = first_of(df, ("normalized_url", "candidate_url"))
    return F.when(url != "", url).otherwise(F.concat_ws("|", F.lit("fallback"), trimmed(df, "source"), trimmed(df, "archive_year"), title))


def main_category(bucket: Column) -> Column:
    b = X.blank(bucket)
    return F.when(b.isin("case_strong", "not_candidate"), b).when(b.startswith("case_review"), "case_review").when(b.startswith("topic"), "topic").otherwise("other")


def category_priority(bucket: Column) -> Column:
    return ranked(main_category(bucket), CATEGORY_PRIORITY, 0)


def text_length(df: DataFrame) -> Column:
    if "text_length" in df.columns:
        return F.coalesce(F.col("text_length").cast("string").try_cast("double"), F.lit(0.0)).cast("long")
    return F.length(first_of(df, BODIES)).cast("long")


def best_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], **stats: Column) -> DataFrame:
    """One row for each key, the least by ``order``, with aggregates over all its rows.

    One aggregate: each map task sends one row for a key at most, so a key with
    a third of all rows is no single task. Null keys are a key. What ``order``
    leaves tied is settled by a hash of the row.
    """
    rest = [c for c in df.columns if c not in keys]
    whole = F.xxhash64(*[F.col(c) for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()])
    rank = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], whole.alias("h"))
    best = F.min_by(F.struct(*rest), rank).alias("__best")
    found = df.groupBy(*keys).agg(best, *[c.alias(name) for name, c in stats.items()])
    return found.select(*keys, *[F.col("__best")[c].alias(c) for c in rest], *stats).select(*df.columns, *stats)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keeps the first row of each key, in the order given."""
    return best_rows(df, keys, order)


def input_order(df: DataFrame) -> list[Column]:
    """What stands for the order of the input: run, capture time, then address."""
    return [X.blank(F.col(c).cast("string")) for c in existing(df, ("run_id", "snapshot_timestamp", "timestamp", "candidate_url"))]


def deduplicate_articles(snapshots: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """One row for each year and article: best status, then score, then longest text; with statistics of its captures."""
    df = snapshots.withColumns({"_status_rank": ranked(F.col("provisional_case_status"), STATUS_RANK, -1), "text_length": text_length(snapshots)})
    if "snapshot_datetime" not in df.columns:
        df = df.withColumn("snapshot_datetime", F.lit(None).cast("timestamp_ntz"))
    by = [-F.col("_status_rank"), -F.coalesce(F.col("contextual_score"), F.lit(-1)), -F.col("text_length"), *(input_order(df) if order is None else order)]
    return best_rows(df, ("archive_year", "_article_key"), by, snapshot_count=F.count(F.lit(1)), first_snapshot_datetime=F.min("snapshot_datetime"), last_snapshot_datetime=F.max("snapshot_datetime"))


def deduplicate_news(classified: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """One row for each year and article: strongest category, then longest text."""
    df = classified.withColumn("retrieval_bucket", F.coalesce("retrieval_bucket", F.lit("unknown")))
    df = df.withColumns({"main_category": main_category(F.col("retrieval_bucket")), "_category_priority": category_priority(F.col("retrieval_bucket")), "text_length": text_length(df) if "text_length" in df.columns else F.lit(0).cast("long")})
    return best_rows(df, ("archive_year", "_article_key"), [-F.col("_category_priority"), -F.col("text_length"), *(input_order(df) if order is None else order)])


def in_years(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.where(F.col("archive_year").between(start, end))


def with_excerpt(df: DataFrame, n: int = 600) -> DataFrame:
    """An existing excerpt is cut anew; else it is made of the body."""
    return df.withColumn("text_excerpt", X.excerpt(F.col("text_excerpt") if "text_excerpt" in df.columns else first_of(df, BODIES), n))
