"""The final corpora: scope alerts, manual decisions, subsets and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import let
from .articles import decision_key, existing
from .matching import shows

# Statuses of each corpus, decisions that may be given, columns of the pending list.
MAIN = ("candidate_explicit_case", "candidate_contextual_high")
SENSITIVITY = ("review_contextual_medium",)
AMBIGUOUS = ("review_ambiguous_case",)
DECISIONS = ("", "exclude", "include", "review")
PENDING = ("article_key", "normalized_url", "candidate_url", "archive_year", "country", "source", "provisional_case_status", "gender_recognition_mode", "violence_direction", "auto_scope_status", "auto_scope_reason", "title_clean", "title", "text_excerpt", "manual_scope_decision")
ALERT_CHARS = 4000


def alert_text(df: DataFrame) -> Column:
    """Title, anchor and the head of the body (or of its excerpt), normalized."""
    pick = lambda names: F.coalesce(*[F.when(X.strip(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in existing(df, names)], F.lit(""))
    body = F.substring(pick(("text_clean", "text", "text_raw", "text_excerpt")), 1, ALERT_CHARS)
    return X.normalize(F.concat_ws("\n", pick(("title_clean", "title", "title_raw")), pick(("anchor_text",)), body))


def scope_reason(direction: Column, norm: Column) -> Column:
    """Why a row is outside of the scope perhaps; empty without an alert."""
    return (
        F.when(X.strip(X.blank(direction)) == "female_to_male", "female_aggressor_male_victim")
        .when(shows(norm, "clearly her against him"), "possible_female_aggressor_male_victim")
        .when(shows(norm, "clearly her against her"), "possible_female_aggressor_female_victim")
        .when(shows(norm, "possibly her"), "possible_female_aggressor")
        .otherwise("")
    )


def with_scope_alert(df: DataFrame) -> DataFrame:
    """Adds ``auto_scope_status`` and ``auto_scope_reason``. An alert excludes nothing."""
    way = F.col("violence_direction") if "violence_direction" in df.columns else F.lit("")
    df = df.withColumn("auto_scope_reason", let(alert_text(df), lambda n: scope_reason(way, n)))
    return df.withColumn("auto_scope_status", F.when(F.col("auto_scope_reason") == "", "no_alert").otherwise("alert"))


def decisions(given: DataFrame, order: str | None = None) -> DataFrame:
    """(article_key, manual_scope_decision), the last for each key by ``order`` (else by the decision itself).

    Raises on a decision that may not be given.
    """
    if "manual_scope_decision" not in given.columns:
        raise KeyError("manual_scope_decision is missing")
    if "article_key" not in given.columns:
        given = given.withColumn("article_key", decision_key(given))
    given = given.withColumn("manual_scope_decision", X.normalize_label(F.col("manual_scope_decision")))
    wrong = sorted(r[0] for r in given.select("manual_scope_decision").where(~F.col("manual_scope_decision").isin(*DECISIONS)).distinct().limit(5).collect())
    if wrong:
        raise ValueError("unknown manual_scope_decision: " + ", ".join(wrong))
    last = F.col(order) if order else F.col("manual_scope_decision")
    return given.groupBy("article_key").agg(F.max_by("manual_scope_decision", F.struct(last.alias("a"), F.col("manual_scope_decision").alias("b"))).alias("manual_scope_decision"))


def with_decisions(candidates: DataFrame, given: DataFrame | None, order: str | None = None) -> DataFrame:
    """Adds ``article_key`` and the manual decision, empty without one."""
    candidates = candidates.drop("manual_scope_decision").withColumn("article_key", decision_key(candidates))
    if given is None:
        return candidates.withColumn("manual_scope_decision", F.lit(""))
    return candidates.join(decisions(given, order), "article_key", "left").withColumn("manual_scope_decision", F.coalesce("manual_scope_decision", F.lit("")))


def candidates(unique: DataFrame, given: DataFrame | None, order: str | None = None) -> DataFrame:
    """The rows with a status of some corpus, with alerts and decisions."""
    if "provisional_case_status" not in unique.columns:
        raise KeyError("provisional_case_status is missing")
    return with_decisions(with_scope_alert(unique.where(F.col("provisional_case_status").isin(*MAIN, *SENSITIVITY, *AMBIGUOUS))), given, order)


def conditions() -> dict[str, Column]:
    """What makes a candidate belong to a subset; they overlap. Only ``exclude`` removes a row."""
    status, said = F.col("provisional_case_status"), F.col("manual_scope_decision")
    return {
        "main": status.isin(*MAIN) & (said != "exclude"),
        "sensitivity": status.isin(*SENSITIVITY) & (said != "exclude"),
        "ambiguous": status.isin(*AMBIGUOUS) & (said != "exclude"),
        "excluded": said == "exclude",
        "included": said == "include",
        "pending": ((F.col("auto_scope_status") == "alert") & (said == "")) | (said == "review"),
    }


def subset(found: DataFrame, name: str) -> DataFrame:
    return found.where(conditions()[name])


def undecided(found: DataFrame) -> DataFrame:
    """The alerts without a decision, for those who decide."""
    pending = found.where((F.col("auto_scope_status") == "alert") & (F.col("manual_scope_decision") == ""))
    return pending.select(*existing(pending, PENDING))


def summary(found: DataFrame) -> DataFrame:
    c = conditions()
    names = {"main": "main_case_articles", "sensitivity": "sensitivity_medium_articles", "ambiguous": "ambiguous_articles", "excluded": "manual_exclusions", "included": "manual_inclusions", "pending": "pending_scope_alerts"}
    return found.agg(F.count(F.lit(1)).alias("all_contextual_candidates"), *[F.count_if(c[k]).alias(name) for k, name in names.items()])


def main_distribution(found: DataFrame) -> DataFrame:
    return subset(found, "main").groupBy("provisional_case_status", "gender_recognition_mode").agg(F.count(F.lit(1)).alias("n_articles"))


def exclusion_summary(found: DataFrame) -> DataFrame:
    return subset(found, "excluded").groupBy("provisional_case_status", "auto_scope_reason").agg(F.count(F.lit(1)).alias("n_articles"))
