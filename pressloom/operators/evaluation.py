"""Precision of the manual labels: per group, with Wilson intervals, and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .reports import crosstab

# Labels that may be given.
CASE_LABELS = ("not_relevant", "relevant", "uncertain")
RECOGNITION_LABELS = ("contextual", "explicit", "insufficient")
Z = 1.96
REQUIRED = ("manual_case_label", "manual_gender_recognition", "validation_group")


def wilson(successes: Column, total: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the interval within 0 and 1; null for no trials."""
    p, zz = successes / F.nullif(total, F.lit(0)), F.lit(z * z)
    below = 1 + zz / total
    centre = (p + zz / (2 * total)) / below
    margin = F.lit(z) * F.sqrt((p * (1 - p) + zz / (4 * total)) / total) / below
    return F.when(total > 0, F.greatest(F.lit(0.0), centre - margin)), F.when(total > 0, F.least(F.lit(1.0), centre + margin))


def reviewed(df: DataFrame, case_labels=CASE_LABELS, recognition_labels=RECOGNITION_LABELS) -> DataFrame:
    """The rows with a case label, labels normalized. Raises on missing columns, unknown labels, and where nothing is labelled."""
    if missing := sorted(set(REQUIRED) - set(df.columns)):
        raise KeyError("missing columns: " + ", ".join(missing))
    out = normalized(df).where("manual_case_label <> ''")
    wrong = out.where(~F.col("manual_case_label").isin(*case_labels) | ~F.col("manual_gender_recognition").isin("", *recognition_labels))
    if found := wrong.select("manual_case_label", "manual_gender_recognition").distinct().limit(5).collect():
        raise ValueError("unknown labels: " + ", ".join(sorted(f"{r[0]}/{r[1]}" for r in found)))
    if out.isEmpty():
        raise ValueError("no labelled rows")
    return out


def normalized(df: DataFrame) -> DataFrame:
    return df.withColumns({c: X.normalize_label(F.col(c).cast("string")) for c in ("manual_case_label", "manual_gender_recognition")})


def summarize(labelled: DataFrame) -> DataFrame:
    """One row for each validation group: counts, precisions and interval."""
    label = F.col("manual_case_label")
    weight = F.coalesce(F.col("sample_weight").cast("string").try_cast("double"), F.lit(1.0)) if "sample_weight" in labelled.columns else F.lit(1.0)
    sums = labelled.withColumn("__w", weight).groupBy("validation_group").agg(
        F.count(F.lit(1)).alias("n_reviewed"), *[F.count_if(label == k).alias(f"n_{k}") for k in ("relevant", "not_relevant", "uncertain")],
        F.coalesce(F.sum(F.when(label == "relevant", F.col("__w"))), F.lit(0.0)).alias("__good"), F.coalesce(F.sum(F.when(label.isin("relevant", "not_relevant"), F.col("__w"))), F.lit(0.0)).alias("__all"),
    )
    good, decided = F.col("n_relevant"), F.col("n_relevant") + F.col("n_not_relevant")
    low, high = wilson(good, decided)
    return sums.select(
        "validation_group", "n_reviewed", "n_relevant", "n_not_relevant", "n_uncertain", (good / F.nullif(decided, F.lit(0))).alias("precision_excluding_uncertain"),
        (F.col("__good") / F.nullif("__all", F.lit(0.0))).alias("weighted_precision_excluding_uncertain"), (good / F.col("n_reviewed")).alias("conservative_precision"), low.alias("wilson_95_low"), high.alias("wilson_95_high"),
    )


def confusion(labelled: DataFrame) -> DataFrame:
    """Groups by case labels."""
    return crosstab(labelled, "validation_group", "manual_case_label", CASE_LABELS)


def recognition(labelled: DataFrame, labels=RECOGNITION_LABELS) -> DataFrame:
    """Groups by recognition labels, of the rows that have one."""
    return crosstab(labelled.where("manual_gender_recognition <> ''"), "validation_group", "manual_gender_recognition", labels)


def errors(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("manual_case_label").isin("not_relevant", "uncertain"))


def overall(sample: DataFrame) -> DataFrame:
    """One row: size, share reviewed, and how many hard negatives were relevant after all."""
    label, hard = F.col("manual_case_label"), (F.col("validation_group") == "hard_negative") & (F.col("manual_case_label") != "")
    counts = normalized(sample).agg(F.count(F.lit(1)).alias("n_rows_in_sample"), F.count_if(label != "").alias("n_reviewed"), F.count_if(hard & (label == "relevant")).alias("__a"), F.count_if(hard).alias("__b"))
    return counts.select("n_rows_in_sample", "n_reviewed", (F.col("n_reviewed") / F.nullif("n_rows_in_sample", F.lit(0))).alias("completion_rate"), (F.col("__a") / F.nullif("__b", F.lit(0))).alias("hard_negative_relevant_rate"))
