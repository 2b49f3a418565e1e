"""Counts, cross tables, coverage and audits over classified articles.

All are partial aggregates before their shuffle. Null keys are kept where a
table says so and dropped elsewhere, as each report has always done.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .articles import PRIORITY_RANK, existing, ranked

CATEGORIES = ("case_strong", "case_review", "topic", "not_candidate", "other")
# Statuses and buckets in the order of the tables.
STATUSES = ("candidate_explicit_case", "candidate_contextual_high", "review_contextual_medium", "review_ambiguous_case", "topic_explicit_not_case", "not_selected")
BUCKETS = ("case_strong", "case_review_female_disappearance", "case_review_possible_violence", "case_review_female_death", "topic_gender_violence", "topic_policy_or_prevention", "not_candidate")
REPORT = (
    "archive_year", "country", "source", "run_id", "snapshot_timestamp", "title_clean", "title", "anchor_text", "normalized_url", "candidate_url", "retrieval_bucket", "match_reasons_json",
    "explicit_label_type", "explicit_label_terms_json", "contextual_evidence_level", "contextual_reasons_json", "contextual_all_reasons_json", "violence_direction", "contextual_violence_types_json",
    "contextual_evidence_json", "gender_recognition_mode", "provisional_case_status", "review_priority", "snapshot_count", "first_snapshot_datetime", "last_snapshot_datetime", "text_excerpt",
)
REVIEW_COLUMNS = ("manual_case_label", "manual_gender_recognition", "manual_notes")


def counts(df: DataFrame, keys: Sequence[str], name: str = "n", nulls: bool = True) -> DataFrame:
    """Rows for each key; with ``nulls`` false, rows with a null key are left out."""
    if not nulls:
        df = df.na.drop(subset=list(keys))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def wide(df: DataFrame, key: str, category: str, values: Sequence[str] | None = None) -> DataFrame:
    """One row for each key and a column for each category, zero where there is none.

    ``values`` fixes the columns; without it they are what occurs, which takes one more pass.
    """
    table = df.groupBy(key).pivot(category, list(values)) if values else df.groupBy(key).pivot(category)
    out = table.agg(F.count(F.lit(1)))
    return out.na.fill(0, [c for c in out.columns if c != key])


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence[str] | None = None) -> DataFrame:
    return wide(df, rows, columns, values)


# ---- years and categories -------------------------------------------------


def buckets_by_year(unique: DataFrame) -> DataFrame:
    return counts(unique, ("archive_year", "retrieval_bucket"), "n_unique_news")


def buckets_by_source(unique: DataFrame) -> DataFrame:
    return counts(unique, ("archive_year", "country", "source", "retrieval_bucket"), "n_unique_news")


def categories_by_year(unique: DataFrame) -> DataFrame:
    """All main categories of each year, with sums."""
    out = wide(unique, "archive_year", "main_category", CATEGORIES)
    total = sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0]))
    return out.select("archive_year", "case_strong", "case_review", (F.col("case_strong") + F.col("case_review")).alias("all_case_candidates"), "topic", "not_candidate", "other", total.alias("total_unique_news"))


def coverage(unique: DataFrame) -> DataFrame:
    """Distinct articles and categories of each year, country and source."""
    b = X.blank(F.col("retrieval_bucket"))
    out = unique.groupBy("archive_year", "country", "source").agg(F.count_distinct("_article_key").alias("total_unique_news"), F.count_if(b == "case_strong").alias("case_strong"), F.count_if(b.startswith("case_review")).alias("case_review"), F.count_if(b.startswith("topic")).alias("topic"))
    return out.withColumn("case_candidate_rate", (F.col("case_strong") + F.col("case_review")) / F.nullif("total_unique_news", F.lit(0)))


def contextual_coverage(unique: DataFrame) -> DataFrame:
    s = F.col("provisional_case_status")
    names = {"explicit_case_candidates": "candidate_explicit_case", "contextual_high": "candidate_contextual_high", "contextual_medium": "review_contextual_medium", "ambiguous_cases": "review_ambiguous_case"}
    out = unique.groupBy("archive_year", "country", "source").agg(F.count_distinct("_article_key").alias("total_unique_news"), *[F.count_if(s == v).alias(k) for k, v in names.items()])
    return out.withColumn("implicit_candidate_rate", (F.col("contextual_high") + F.col("contextual_medium")) / F.nullif("total_unique_news", F.lit(0)))


def long_summary(unique: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    return counts(unique, (*keys, category), "n_unique_news")


def dedup_audit(before: DataFrame, after: DataFrame, start: int, end: int) -> DataFrame:
    a = before.agg(F.count(F.lit(1)).alias("classified_rows_before_deduplication"))
    b = after.agg(F.count(F.lit(1)).alias("unique_news_after_deduplication"))
    both = a.join(F.broadcast(b))  # a row each
    return both.select(F.lit(start).alias("start_year"), F.lit(end).alias("end_year"), *both.columns, (F.col("classified_rows_before_deduplication") - F.col("unique_news_after_deduplication")).alias("duplicates_removed"))


def contextual_audit(unique: DataFrame, start: int, end: int) -> DataFrame:
    """One row of counts; the captures are the sum of those of the unique rows."""
    s, d = F.col("provisional_case_status"), F.col("violence_direction")
    way = {"reverse_direction_detected": "female_to_male", "possible_male_victim_detected": "possible_male_victim", "mixed_direction_detected": "mixed"}
    out = unique.agg(F.coalesce(F.sum("snapshot_count"), F.lit(0)).alias("snapshot_rows"), F.count(F.lit(1)).alias("unique_article_year_rows"), *[F.count_if(s == k).alias(k) for k in STATUSES], *[F.count_if(d == v).alias(k) for k, v in way.items()])
    return out.select(F.lit(start).alias("start_year"), F.lit(end).alias("end_year"), "snapshot_rows", "unique_article_year_rows", (F.col("snapshot_rows") - F.col("unique_article_year_rows")).alias("duplicate_snapshots_collapsed_for_counts"), *STATUSES, *way)


# ---- lists ----------------------------------------------------------------


def without_label(unique: DataFrame) -> DataFrame:
    found = unique.where("is_contextual_without_label")
    return found.select(*existing(found, REPORT))


def review_queue(unique: DataFrame, sort: bool = True) -> DataFrame:
    """What awaits review, most urgent first, with empty manual columns."""
    queue = unique.where(F.col("review_priority").isin("P1_contextual_high", "P2_contextual_medium", "P3_ambiguous_case"))
    if sort:
        queue = queue.orderBy(ranked(F.col("review_priority"), PRIORITY_RANK, 99), *[F.col(c).asc_nulls_last() for c in existing(queue, ("archive_year", "country", "source"))], F.col("contextual_score").desc())
    queue = queue.withColumns({c: F.lit("") for c in REVIEW_COLUMNS})
    return queue.select(*existing(queue, (*REPORT, *REVIEW_COLUMNS)))


# ---- acquisition ----------------------------------------------------------


def cdx_summary(snapshots: DataFrame) -> DataFrame:
    return counts(snapshots, ("source", "country", "year"), "n_snapshots", nulls=False)


def homepage_diagnostics(diagnostics: DataFrame) -> DataFrame:
    d = diagnostics.na.drop(subset=["source", "country"])
    return d.groupBy("source", "country").agg(
        F.count("timestamp").alias("snapshots_seen"), F.count_if(F.col("fetch_error").isNotNull()).alias("fetch_errors"), F.count_if(F.col("links_extracted") > 0).alias("snapshots_with_links"),
        F.sum("links_extracted").alias("total_links_extracted"), F.avg("links_extracted").alias("avg_links_extracted"),
    )


def has_text(df: DataFrame) -> Column:
    return F.length(X.blank(F.col("text"))) > 0


def article_metrics(articles: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(metric, n): processed, errors, with text, without text; candidates too, if given."""
    one = articles.agg(F.count(F.lit(1)).alias("articles_processed"), F.count_if(F.col("fetch_error").isNotNull()).alias("fetch_or_parse_errors"), F.count_if(has_text(articles)).alias("articles_with_text"), F.count_if(~has_text(articles)).alias("articles_without_text"))
    out = one.unpivot([], one.columns, "metric", "n")
    if candidates is None:
        return out
    return candidates.agg(F.count(F.lit(1)).alias("n")).select(F.lit("clean_candidates").alias("metric"), "n").unionByName(out)


def articles_by_source(articles: DataFrame) -> DataFrame:
    a = articles.na.drop(subset=["source", "country"])
    return a.groupBy("source", "country").agg(F.count(F.lit(1)).alias("articles_processed"), F.count_if(has_text(a)).alias("articles_with_text"), F.count_if(F.col("fetch_error").isNotNull()).alias("fetch_or_parse_errors"), F.avg("text_length").alias("avg_text_length"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return counts(df, (column,), "n_articles")


# ---- stages of a run ------------------------------------------------------

STAGES = ("cdx_snapshots", "homepage_candidates", "clean_candidates", "articles_text", "articles_classified")


def ladder(*steps: tuple[str, str]) -> Column:
    """The name beside the first count that is zero; ok without one."""
    out = F.lit("ok")
    for count, issue in reversed(steps):
        out = F.when(F.coalesce(F.col(count), F.lit(0)) == 0, issue).otherwise(out)
    return out


# Names of the issues.
WINDOW_LADDER = (("cdx_snapshots", "no_cdx"), ("homepage_candidates", "cdx_but_no_homepage_candidates"), ("clean_candidates", "homepage_but_no_clean_candidates"), ("articles_text", "clean_but_no_articles"), ("articles_classified", "articles_but_no_classified"))
SOURCE_LADDER = (*WINDOW_LADDER[:4], ("articles_with_text", "articles_without_text"), WINDOW_LADDER[4])


def stage_rows(stages: dict[str, DataFrame | None]) -> DataFrame:
    """The rows of all stages of a run in one relation: stage, source and what the counts need."""
    parts = []
    for stage in STAGES:
        df = stages.get(stage)
        if df is None:
            continue
        column = lambda c, kind, df=df: (F.col(c) if c in df.columns else F.lit(None)).cast(kind)
        parts.append(df.select(F.lit(stage).alias("stage"), column("source", "string").alias("source"), (F.length(X.blank(column("text", "string"))) > 0).alias("has_text") if "text" in df.columns else F.lit(False).alias("has_text"), column("fetch_error", "string").isNotNull().alias("failed"), column("retrieval_bucket", "string").alias("bucket")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stage_totals(rows: DataFrame, *keys: str) -> DataFrame:
    at = lambda stage: F.col("stage") == stage
    article = at("articles_text")
    return rows.groupBy(*keys).agg(
        *[F.count_if(at(s)).alias(s) for s in STAGES], F.count_if(article & F.col("has_text")).alias("articles_with_text"), F.count_if(article & F.col("failed")).alias("fetch_or_parse_errors"),
        *[F.count_if(at("articles_classified") & (F.col("bucket") == b)).alias(b) for b in ("case_strong", "case_review_possible_violence", "topic_gender_violence", "not_candidate")],
    )


def window_summary(stages: dict[str, DataFrame | None], run_id: str, from_date: str, to_date: str) -> DataFrame:
    """One row for a run: stage counts, sources and those lost between stages, rates, buckets and the issue."""
    rows = stage_rows(stages)
    per_source = stage_totals(rows, "source")
    # sources are few by nature: names of newspapers
    sets = {"cdx": F.col("cdx_snapshots") > 0, "homepage": F.col("homepage_candidates") > 0, "clean": F.col("clean_candidates") > 0, "text": F.col("articles_with_text") > 0, "classified": F.col("articles_classified") > 0}
    sums = [c for c in per_source.columns if c != "source"]
    one = per_source.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], *[F.collect_set(F.when(has, F.col("source"))).alias(f"__{k}") for k, has in sets.items()])
    lost = lambda a, b: F.array_join(F.array_sort(F.array_except(f"__{a}", f"__{b}")), ",")
    rate = lambda c: F.col(c) / F.nullif("articles_text", F.lit(0))
    some = lambda c: F.when(F.col("articles_text") > 0, F.col(c))
    classified = stages.get("articles_classified")
    there = lambda c: F.when(F.col("articles_classified") > 0, F.lit(classified is not None and c in classified.columns))
    return one.select(
        F.lit(run_id).alias("run_id"), F.lit(from_date).alias("from_date"), F.lit(to_date).alias("to_date"), *STAGES,
        F.size("__cdx").cast("long").alias("sources_with_cdx"), F.size("__homepage").cast("long").alias("sources_with_homepage_candidates"), F.size("__clean").cast("long").alias("sources_with_clean_candidates"), F.size("__text").cast("long").alias("sources_with_text"), F.size("__classified").cast("long").alias("sources_classified"),
        lost("cdx", "homepage").alias("missing_homepage_sources"), lost("homepage", "clean").alias("missing_clean_sources"), lost("clean", "text").alias("missing_text_sources"), lost("text", "classified").alias("missing_classified_sources"),
        some("fetch_or_parse_errors").alias("fetch_or_parse_errors"), rate("fetch_or_parse_errors").alias("fetch_error_rate"), some("articles_with_text").alias("articles_with_text"), rate("articles_with_text").alias("text_success_rate"),
        there("text_clean").alias("has_text_clean"), there("title_clean").alias("has_title_clean"),
        *[F.when(F.col("articles_classified") > 0, F.col(b)).alias(b) for b in ("case_strong", "case_review_possible_violence", "topic_gender_violence", "not_candidate")],
        ladder(*WINDOW_LADDER).alias("stage_issue"),
    )


def source_stages(expected: DataFrame, stages: dict[str, DataFrame | None], run_id: str, from_date: str, to_date: str, diagnostics: DataFrame | None = None) -> DataFrame:
    """A row for each expected source: its count at every stage and the issue. ``expected`` is a configuration, so it is small."""
    names = [*STAGES[:4], "articles_with_text", "fetch_or_parse_errors", "articles_classified"]
    totals = stage_totals(stage_rows(stages).where("source IS NOT NULL"), "source").select("source", *names)
    out = expected.select("source", "country", "domain", F.lit(run_id).alias("run_id"), F.lit(from_date).alias("from_date"), F.lit(to_date).alias("to_date")).join(totals, "source", "left").na.fill(0, names)
    if diagnostics is not None:
        more = existing(diagnostics, ("snapshots_seen", "fetch_errors", "snapshots_with_links", "total_links_extracted", "avg_links_extracted"))
        out = out.join(diagnostics.select("source", *more), "source", "left").na.fill(0, more)
    return out.withColumn("source_issue", ladder(*SOURCE_LADDER))


# Shares beyond which a run is a problem.
MOST_ERRORS, LEAST_TEXT = 0.35, 0.60


def problem_windows(summary: DataFrame) -> dict[str, DataFrame]:
    """The parts of a report that need a look."""
    return {
        "stage": summary.where("stage_issue <> 'ok'"),
        "missing_homepage": summary.where("missing_homepage_sources <> ''"),
        "fetch_errors": summary.where(F.coalesce("fetch_error_rate", F.lit(0.0)) > MOST_ERRORS),
        "little_text": summary.where(F.coalesce("text_success_rate", F.lit(1.0)) < LEAST_TEXT),
        "classification": summary.where((F.coalesce("has_text_clean", F.lit(True)) == False) | (F.coalesce("has_title_clean", F.lit(True)) == False) | (F.coalesce("articles_classified", F.lit(0)) == 0)),  # noqa: E712
    }


def report_totals(summary: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("stage_issue") == "ok")
    out = summary.agg(F.count(F.lit(1)).alias("windows"), ok.alias("windows_ok"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*STAGES, "articles_with_text")])
    return out.withColumns({"windows_to_review": F.col("windows") - F.col("windows_ok"), "text_rate": F.col("articles_with_text") / F.nullif("articles_text", F.lit(0))})

