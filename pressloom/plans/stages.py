"""The stages as plans from relation to relation, and their runs over folders.

A stage reads what the one before it has written; a finished stage is not run
again unless forced. ``collect`` covers a window from index to classified
articles, ``contextual_reports``, ``final_corpus``, ``validation_sample`` and
``yearly_tables`` cover all windows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from ..operators import articles as A
from ..operators import candidates as C
from ..operators import contextual, corpus, evaluation, reports, retrieval, sampling
from ..sources import archive, tables
from ..sources.config import RunPaths, expected_sources
from .windows import Window

STAGES = ("cdx", "homepage", "clean", "articles", "retry", "classify")


def classify(articles: DataFrame, lexicon: Lexicon, show_terms: bool = True, keep_match: bool = False) -> DataFrame:
    """Cleaned text and retrieval scores of articles with text, title, anchor_text and source."""
    return retrieval.score(retrieval.cleaned(articles), lexicon, show_terms=show_terms, keep_match=keep_match)


def contextual_snapshots(classified: DataFrame, lexicon: Lexicon, start: int, end: int, row: str | None = None, show_terms: bool = True) -> DataFrame:
    """All captures of the years, with keys and contextual columns; the years are filtered before anything is computed."""
    df = classified.withColumns({"archive_year": A.archive_year(classified), "snapshot_datetime": A.snapshot_datetime(F.col("snapshot_timestamp") if "snapshot_timestamp" in classified.columns else F.lit(None).cast("string"))})
    return contextual.classify(A.with_article_key(A.in_years(df, start, end), row), lexicon, show_terms=show_terms)


def contextual_unique(snapshots: DataFrame, chars: int = 600, order=None) -> DataFrame:
    return A.with_excerpt(A.deduplicate_articles(snapshots, order), chars)


def unique_news(classified: DataFrame, start: int, end: int, row: str | None = None, order=None) -> DataFrame:
    df = A.in_years(classified.withColumn("archive_year", A.archive_year(classified)), start, end)
    return A.deduplicate_news(A.with_article_key(df, row, ("normalized_url", "candidate_url")), order)


# ---- a window ---------------------------------------------------------------


def run_stage(spark: SparkSession, stage: str, paths: RunPaths, window: Window, config: dict, lexicon: Lexicon, opener=archive.open_url, sleep: float = 1.0) -> None:
    """Runs one stage and writes its table, and its summaries beside the reports."""
    report = lambda df, name: tables.write_csv(df, f"{paths.reports}/{name}.csv")
    if stage == "cdx":
        archive.register(spark, opener)
        options = {"sources": json.dumps(config.get("sources") or []), "from": window.from_date, "to": window.to_date, "limit": str(config.get("limit", 100))}
        tables.write(C.unique_snapshots(spark.read.format("cdx").options(**options).load()), paths.table("cdx"))
        report(reports.cdx_summary(tables.parquet(spark, paths.table("cdx"))), "cdx_summary_by_source_year")
    elif stage == "homepage":
        fetched = archive.fetch(tables.parquet(spark, paths.table("cdx")), "timestamp", "original", opener, sleep)
        tables.write(fetched, f"{paths.base}/raw_html/homepages.parquet")
        fetched = tables.parquet(spark, f"{paths.base}/raw_html/homepages.parquet")
        report(C.diagnostics(fetched), "homepage_snapshot_diagnostics")
        report(reports.homepage_diagnostics(C.diagnostics(fetched)), "homepage_snapshot_diagnostics_summary")
        found = C.homepage_candidates(C.links(fetched.where("fetch_error IS NULL")))
        tables.save(found, paths.table("homepage"), f"{paths.reports}/homepage_candidates.csv")
        report(reports.counts(tables.parquet(spark, paths.table("homepage")), ("source", "country"), "n_homepage_candidates", nulls=False), "homepage_candidates_summary")
    elif stage == "clean":
        tables.save(C.clean_candidates(tables.parquet(spark, paths.table("homepage"))), paths.table("clean"), f"{paths.reports}/clean_candidates.csv")
        report(reports.counts(tables.parquet(spark, paths.table("clean")), ("source", "country"), "n_clean_candidates", nulls=False), "clean_candidates_summary")
    elif stage == "articles":
        asked = C.article_requests(tables.parquet(spark, paths.table("clean")))
        done = C.parsed(archive.fetch(asked, "snapshot_timestamp", "article_url", opener, sleep)).drop("article_url").withColumnRenamed("html_name", "html_path")
        tables.write(done, paths.table("articles"))
        done = tables.parquet(spark, paths.table("articles"))
        report(reports.article_metrics(done, tables.parquet(spark, paths.table("clean"))), "articles_text_summary")
        report(reports.articles_by_source(done), "articles_text_by_source")
    elif stage == "retry":
        before = tables.parquet(spark, paths.table("articles"))
        again = C.failed(before).drop("fetch_error", "title", "text", "text_length", "html_path")
        again = C.parsed(archive.fetch(C.article_requests(again), "snapshot_timestamp", "article_url", opener, max(sleep, 3.0) if sleep else 0.0)).drop("article_url").withColumnRenamed("html_name", "html_path")
        kept = f"{paths.base}/extracted_text/articles_text_before_retry.parquet"
        tables.write(before, kept)
        tables.replace(C.merged_retry(before, again), paths.table("articles"))
        report(C.retry_summary(tables.parquet(spark, kept), tables.parquet(spark, paths.table("articles"))), "articles_text_retry_summary")
    elif stage == "classify":
        out = classify(tables.parquet(spark, paths.table("articles")), lexicon)
        tables.write(out, paths.table("classify"))
        out = tables.parquet(spark, paths.table("classify"))
        for name in retrieval.SUBSETS:
            tables.write(retrieval.sort_candidates(retrieval.subset(out, name)), f"{paths.base}/processed/{name}.parquet")
        for column in ("retrieval_bucket", "candidate_label", "candidate_type"):
            report(reports.value_counts(out, column), f"{column}_counts")
    else:
        raise ValueError(f"no stage {stage!r}")


def collect(spark: SparkSession, root: str, windows: list[Window], config: dict, lexicon: Lexicon, opener=archive.open_url, sleep: float = 1.0, retry: bool = True, force: bool = False, go_on: bool = False, say: Callable[[str], None] = print) -> None:
    """Runs the stages of every window. A failed stage ends its window, and with ``go_on`` false everything."""
    for window in windows:
        paths = RunPaths(root, window.run_id)
        for stage in STAGES:
            if stage == "retry" and not retry:
                continue
            if not force and tables.exists(spark, paths.table(stage)):
                say(f"{window.run_id} {stage}: there already")
                continue
            try:
                run_stage(spark, stage, paths, window, config, lexicon, opener, sleep)
                say(f"{window.run_id} {stage}: done")
            except Exception as e:
                say(f"{window.run_id} {stage}: failed: {type(e).__name__}: {e}")
                if not go_on:
                    raise
                break


# ---- over all windows -------------------------------------------------------


def yearly_tables(spark: SparkSession, root: str, start: int, end: int) -> None:
    classified = tables.runs(spark, root)
    if "retrieval_bucket" not in classified.columns:
        raise KeyError("retrieval_bucket is missing")
    out = f"{root}/outputs/tables"
    news = unique_news(classified, start, end)
    before = A.in_years(classified.withColumn("archive_year", A.archive_year(classified)), start, end)
    tables.write(news, f"{root}/outputs/reports/unique_news.parquet")
    news = tables.parquet(spark, f"{root}/outputs/reports/unique_news.parquet")
    for name, df in {
        "news_by_year_and_retrieval_bucket_long": reports.buckets_by_year(news), "news_by_year_and_retrieval_bucket_wide": reports.wide(news, "archive_year", "retrieval_bucket"), "news_by_year_and_main_category": reports.categories_by_year(news),
        "news_by_year_country_source_category": reports.buckets_by_source(news), "coverage_by_year_country_source": reports.coverage(news), "news_by_year_deduplication_audit": reports.dedup_audit(before, news, start, end),
    }.items():
        tables.write_csv(df, f"{out}/{name}.csv")


def contextual_reports(spark: SparkSession, root: str, lexicon: Lexicon, start: int, end: int, chars: int = 600) -> None:
    base = f"{root}/outputs/reports"
    tables.write(contextual_snapshots(tables.runs(spark, root), lexicon, start, end), f"{base}/articles_contextual_snapshots.parquet", ("archive_year",))
    tables.write(contextual_unique(tables.parquet(spark, f"{base}/articles_contextual_snapshots.parquet"), chars), f"{base}/articles_contextual_unique.parquet")
    unique = tables.parquet(spark, f"{base}/articles_contextual_unique.parquet")
    place = ("archive_year", "country", "source")
    for name, df in {
        "tables/gender_recognition_by_year": reports.long_summary(unique, ("archive_year",), "gender_recognition_mode"), "tables/gender_recognition_by_year_country_source": reports.long_summary(unique, place, "gender_recognition_mode"),
        "tables/contextual_case_status_by_year": reports.long_summary(unique, ("archive_year",), "provisional_case_status"), "tables/contextual_coverage_by_year_country_source": reports.contextual_coverage(unique),
        "reports/contextual_without_explicit_label": reports.without_label(unique), "reports/contextual_review_queue": reports.review_queue(unique), "audits/contextual_classification_audit": reports.contextual_audit(unique, start, end),
    }.items():
        tables.write_csv(df, f"{root}/outputs/{name}.csv")


def final_corpus(spark: SparkSession, root: str, given: DataFrame | None = None) -> None:
    out = f"{root}/outputs/final"
    tables.write(corpus.candidates(tables.parquet(spark, f"{root}/outputs/reports/articles_contextual_unique.parquet"), given), f"{out}/candidates.parquet")
    found = tables.parquet(spark, f"{out}/candidates.parquet")
    for subset, name in {"main": "case_articles_main", "sensitivity": "case_articles_sensitivity_medium", "ambiguous": "case_articles_ambiguous", "excluded": "excluded_by_manual_scope_decision", "included": "manually_included_scope_articles", "pending": "scope_alerts_pending_review"}.items():
        tables.write(corpus.subset(found, subset), f"{out}/{name}.parquet")
    for name, df in {"female_aggressor_scope_decisions_pending": corpus.undecided(found), "final_case_corpus_summary": corpus.summary(found), "main_corpus_distribution": corpus.main_distribution(found), "manual_scope_exclusion_summary": corpus.exclusion_summary(found)}.items():
        tables.write_csv(df, f"{out}/{name}.csv")


def validation_sample(spark: SparkSession, unique: DataFrame, out: str, sizes: dict[str, int] | None = None, seed: int = sampling.SEED) -> None:
    if missing := {"retrieval_bucket", "provisional_case_status", "gender_recognition_mode", "contextual_evidence_level"} - set(unique.columns):
        raise KeyError("missing columns: " + ", ".join(sorted(missing)))
    unique = A.with_excerpt(unique, 800)
    tables.write(sampling.pilot(unique, sizes, seed), f"{out}/contextual_validation_pilot.parquet")
    pilot = tables.parquet(spark, f"{out}/contextual_validation_pilot.parquet")
    for name, df in {
        "contextual_validation_pilot": pilot, "contextual_validation_pilot_distribution": sampling.distribution(pilot), "provisional_status_by_retrieval_bucket": reports.crosstab(unique, "retrieval_bucket", "provisional_case_status", reports.STATUSES),
        "recognition_mode_by_provisional_status": reports.crosstab(unique, "provisional_case_status", "gender_recognition_mode"), "contextual_level_by_retrieval_bucket": reports.crosstab(unique, "retrieval_bucket", "contextual_evidence_level", contextual.LEVELS),
        "provisional_status_by_year_country_source": reports.long_summary(unique, ("archive_year", "country", "source"), "provisional_case_status"),
    }.items():
        tables.write_csv(df, f"{out}/{name}.csv")


def evaluate(spark: SparkSession, sample: DataFrame, out: str) -> None:
    labelled = evaluation.reviewed(sample)
    for name, df in {"summary": evaluation.summarize(labelled), "confusion": evaluation.confusion(labelled), "recognition": evaluation.recognition(labelled), "errors": evaluation.errors(labelled), "overall": evaluation.overall(sample)}.items():
        tables.write_csv(df, f"{out}/contextual_validation_{name}.csv")


# ---- the report of a pipeline -------------------------------------------------

EMPTY = "source string, country string, text string, fetch_error string, retrieval_bucket string"


def stage_tables(spark: SparkSession, root: str, window: Window) -> dict[str, DataFrame]:
    paths = RunPaths(root, window.run_id)
    return {name: tables.parquet_or_empty(spark, paths.table(stage), EMPTY) for name, stage in zip(reports.STAGES, ("cdx", "homepage", "clean", "articles", "classify"))}


def pipeline_report(spark: SparkSession, root: str, windows: list[Window], config: dict, label: str) -> str:
    """Writes summaries of all windows and returns a text for people."""
    sources = expected_sources(spark, config)
    summary = by_source = None
    for w in windows:
        found = stage_tables(spark, root, w)
        path = RunPaths(root, w.run_id).table("diagnostics")
        diagnostics = tables.csv(spark, path) if tables.exists(spark, path) else None
        if diagnostics is not None:
            diagnostics = diagnostics.select("source", *[F.col(c).cast("double").alias(c) for c in diagnostics.columns if c not in ("source", "country")])
        one, each = reports.window_summary(found, w.run_id, w.from_date, w.to_date), reports.source_stages(sources, found, w.run_id, w.from_date, w.to_date, diagnostics)
        summary = one if summary is None else summary.unionByName(one)
        by_source = each if by_source is None else by_source.unionByName(each, allowMissingColumns=True)
    out = f"{root}/outputs/reports/pipeline"
    tables.write(summary, f"{out}/pipeline_summary_{label}.parquet")
    tables.write(by_source, f"{out}/pipeline_by_source_{label}.parquet")
    summary, by_source = tables.parquet(spark, f"{out}/pipeline_summary_{label}.parquet"), tables.parquet(spark, f"{out}/pipeline_by_source_{label}.parquet")
    tables.write_csv(summary, f"{out}/pipeline_summary_{label}.csv")
    tables.write_csv(by_source, f"{out}/pipeline_by_source_{label}.csv")
    tables.write_csv(by_source.where("source_issue <> 'ok'"), f"{out}/pipeline_problem_sources_{label}.csv")
    text = report_text(summary, by_source, label)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/pipeline_review_{label}.txt")
    return text


#: Rows that a section of the report shows; the tables hold all.
SHOWN = {"stage": 30, "missing_homepage": 40, "sources": 50, "fetch_errors": 30, "little_text": 30, "classification": 30}


def report_text(summary: DataFrame, by_source: DataFrame, label: str) -> str:
    """A window is one row of ``summary``, so what is shown is small; each section is cut at ``SHOWN``."""
    t = reports.report_totals(summary).first()
    rate = f"{t.text_rate:.1%}" if t.text_rate is not None else "-"
    out = [f"PIPELINE REPORT: {label}", "", f"windows: {t.windows}, ok: {t.windows_ok}, to review: {t.windows_to_review}", *[f"{k}: {t[k]:,}" for k in (*reports.STAGES, "articles_with_text")], f"share with text: {rate}", "", "ISSUES"]
    out += [f"- {r.stage_issue}: {r.n}" for r in reports.counts(summary, ("stage_issue",)).orderBy(F.col("n").desc(), "stage_issue").collect()]
    sections = {
        "stage": ("WINDOWS TO REVIEW", ("run_id", "stage_issue", *reports.STAGES)), "missing_homepage": ("SOURCES WITH CAPTURES BUT NO CANDIDATES", ("run_id", "missing_homepage_sources")),
        "fetch_errors": ("MANY FETCH ERRORS", ("run_id", "fetch_or_parse_errors", "articles_text", "fetch_error_rate")), "little_text": ("LITTLE TEXT", ("run_id", "articles_with_text", "articles_text", "text_success_rate")),
        "classification": ("CLASSIFICATION", ("run_id", "articles_classified", "has_text_clean", "has_title_clean", "stage_issue")),
    }
    parts = reports.problem_windows(summary) | {"sources": by_source.where("source_issue <> 'ok'")}
    sections["sources"] = ("SOURCES TO REVIEW", ("run_id", "source", "source_issue", *reports.STAGES))
    for key, (title, columns) in sections.items():
        rows = parts[key].select(*columns).orderBy(*columns[:2]).limit(SHOWN[key] + 1).collect()
        out += ["", title, *["  ".join(f"{c}={r[c]}" for c in columns) for r in rows[: SHOWN[key]]]]
        out += ["none"] if not rows else [f"... more in the tables of {label}"] if len(rows) > SHOWN[key] else []
    return "\n".join(out) + "\n"
