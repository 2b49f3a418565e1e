"""Retrieval scoring of articles: ordered rules over group matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicon import Lexicon, plain
from .matching import combo, has, mark, matched_text, shows, strings, terms_of

# Group paths, scores, reasons and limits of the rules.
FEMALE = ("female_reference_terms.gendered_phrases", "female_reference_terms.strong")
DEATH = "indirect_terms.victim_death_phrases."
#: (name, groups beside a female reference, score, reason) in the order of the rules.
COMBOS = (
    ("violent", (DEATH + "violent_or_suspicious",), 10, "female_reference_plus_violent_or_suspicious_death"),
    ("gone", ("indirect_terms.disappearance_phrases",), 7, "female_reference_plus_disappearance"),
    ("injured", ("indirect_terms.injury_or_method_terms",), 6, "female_reference_plus_injury_or_method"),
    ("dead", (DEATH + "ambiguous_or_accidental",), 4, "female_reference_plus_ambiguous_or_accidental_death"),
    ("crime", ("indirect_terms.generic_crime_terms",), 0, "female_reference_plus_generic_crime_observed"),
    ("topic", ("digital_or_cyber_violence_terms", "sexual_violence_terms", "violence_types_and_modalities.digital_or_cyber_violence", "violence_types_and_modalities.types"), 0, "female_reference_plus_explicit_violence_topic"),
)
MOST_EXPLICIT = ("asesinato por razones de genero", "femicid", "feminicid", "muerte violenta de mujeres", "muerte violenta de una mujer")
BODY, EVIDENCE_PER_RULE, EVIDENCE = 2500, 3, 5


def article_text(df: DataFrame, title: tuple[str, ...], body: tuple[str, ...]) -> Column:
    """Anchor, title and the head of the body, a line each; the first filled column of those there counts."""
    pick = lambda names: F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in names if c in df.columns], F.lit(""))
    return F.concat_ws("\n", pick(("anchor_text",)), pick(title), F.substring(pick(body), 1, BODY))


def matched(df: DataFrame, lexicon: Lexicon, title=("title",), body=("text",)) -> DataFrame:
    """Adds ``__m``: terms, groups and windows of each article."""
    return df.withColumn("__m", matched_text(article_text(df, title, body), lexicon))


def label_of(score: Column, thresholds: dict[str, int]) -> Column:
    out = F.lit("not_candidate")
    for name in ("review_candidate", "weak_candidate", "strong_candidate"):
        out = F.when(score >= thresholds[name], name).otherwise(out)
    return out


def male_victim(head: Column) -> Column:
    """Of the normalized head of a window."""
    return shows(head, "man as victim")


def explicit(marks: Column, lexicon: Lexicon) -> Column:
    """Whether one of the most explicit direct terms is among those of a text."""
    terms = [t for t in lexicon.terms("direct_terms.high_precision") if any(m in plain(t) for m in MOST_EXPLICIT)]
    return F.arrays_overlap(marks, strings(map(mark, terms))) if terms else F.lit(False)


def score(df: DataFrame, lexicon: Lexicon, title=("title",), body=("text",), show_terms: bool = True, keep_match: bool = False) -> DataFrame:
    """Adds scores, labels, bucket, reasons, evidence and, if asked, the matched terms.

    ``keep_match`` leaves ``__m`` for a contextual classification in the same plan.
    """
    df = matched(df, lexicon, title, body)
    found = F.struct(*[combo(F.col("__m.windows"), lexicon, FEMALE, groups).alias(name) for name, groups, _, _ in COMBOS])
    df = df.withColumn("__c", found)
    df = df.withColumn("__evidence", F.concat(*[F.slice(F.col(f"__c.{name}"), 1, EVIDENCE_PER_RULE) for name, _, _, _ in COMBOS]))
    on = {name: F.size(F.col(f"__c.{name}")) > 0 for name, _, _, _ in COMBOS}
    g = F.col("__m.groups")
    direct, law, aid, structure = (has(g, lexicon, p) for p in ("direct_terms.high_precision", "direct_terms.legal_policy_terms", "help_and_prevention_terms", "structural_context_terms"))
    top = direct & explicit(F.col("__m.terms"), lexicon)
    case = F.greatest(F.when(top, 12).otherwise(0), *[F.when(on[name], n).otherwise(0) for name, _, n, _ in COMBOS if n])
    topic = F.greatest(*[F.when(c, n).otherwise(0) for c, n in ((direct, 10), (law, 6), (structure, 5), (aid, 4), (on["topic"], 4))])
    bucket = (
        F.when(top | on["violent"], "case_strong")
        .when(on["injured"], "case_review_possible_violence")
        .when(on["gone"], "case_review_female_disappearance")
        .when(direct, "topic_gender_violence")
        .when(law | aid, "topic_policy_or_prevention")
        .when(structure, "topic_gender_violence")
        .when(on["dead"], "case_review_female_death")
        .when(on["topic"], "topic_gender_violence")
        .otherwise("not_candidate")
    )
    df = df.withColumns({"__bucket": bucket, "__case": case, "topic_score": topic})
    out = F.col("__bucket").startswith("case_review") & F.exists("__evidence", lambda w: male_victim(w["head"]))
    df = df.withColumn("__male", out)
    accident = F.exists("__evidence", lambda w: has(w["groups"], lexicon, "accident_or_disaster_terms.strong"))
    reasons = [F.when(top, "explicit_femicide_or_gender_murder_term").when(direct, "direct_gender_violence_term"), F.when(law, "legal_or_policy_term"), F.when(aid, "help_or_prevention_resource"), F.when(structure, "structural_gender_context")]
    reasons += [F.when(on[name], reason) for name, _, _, reason in COMBOS] + [F.when(accident, "possible_accident_or_disaster_context"), F.when(F.col("__male"), "male_victim_context_exclusion")]
    df = df.withColumns({
        "case_score": F.when(F.col("__male"), 0).otherwise(F.col("__case")),
        "retrieval_bucket": F.when(F.col("__male"), "not_candidate").otherwise(F.col("__bucket")),
        "match_reasons": F.array_sort(F.array_compact(F.array(*reasons))),
    })
    df = df.withColumns({"case_label": label_of(F.col("case_score"), lexicon.thresholds), "topic_label": label_of(F.col("topic_score"), lexicon.thresholds)})
    is_case, is_topic = F.col("retrieval_bucket").startswith("case_"), F.col("topic_label") != "not_candidate"
    df = df.withColumns({
        "is_case_candidate": is_case,
        "is_topic_candidate": is_topic,
        "is_retrieval_candidate": is_case | is_topic,
        "relevance_score": F.greatest("case_score", "topic_score"),
        "candidate_label": F.when(F.col("retrieval_bucket") == "case_strong", "strong_candidate").when(F.col("retrieval_bucket").startswith("case_review"), "review_candidate").when(F.col("retrieval_bucket").startswith("topic"), "weak_candidate").otherwise("not_candidate"),
        "candidate_type": F.when(is_case & is_topic, "case_and_topic").when(is_case, "case").when(is_topic, "topic").otherwise("none"),
    })
    shown = F.slice("__evidence", 1, EVIDENCE)
    if show_terms:
        df = df.withColumn("matched_terms", F.when(F.size("__m.groups") > 0, terms_of(F.col("__m.terms"), lexicon)))
        df = df.withColumn("proximity_evidence", F.transform(shown, lambda w: F.struct(w["window_id"].alias("window_id"), w["window_text"].alias("window_text"), terms_of(w["terms"], lexicon).alias("matches"))))
        df = df.withColumns({"matched_terms_json": F.to_json(F.coalesce("matched_terms", F.create_map().cast("map<string,array<string>>"))), "matched_groups_json": F.to_json("__m.groups"), "match_reasons_json": F.to_json("match_reasons"), "proximity_evidence_json": F.to_json("proximity_evidence")})
    else:
        df = df.withColumn("proximity_evidence", F.transform(shown, lambda w: F.struct(w["window_id"].alias("window_id"), w["window_text"].alias("window_text"), w["groups"].alias("groups"))))
    return df.drop("__c", "__evidence", "__bucket", "__case", "__male", *(() if keep_match else ("__m",)))


def cleaned(articles: DataFrame) -> DataFrame:
    """Keeps raw text and title beside the cleaned ones, which become ``text`` and ``title``."""
    out = articles.withColumns({"text_raw": F.col("text"), "title_raw": F.col("title")})
    out = out.withColumns({"text_clean": X.clean_text(F.col("text_raw"), F.col("source")), "title_clean": X.clean_title(F.col("title_raw"))})
    return out.withColumns({"text": F.col("text_clean"), "title": F.col("title_clean")})


SUBSETS = {
    "candidates": "is_retrieval_candidate",
    "case_candidates": "is_case_candidate",
    "strong_cases": "retrieval_bucket = 'case_strong'",
    "review_cases": "retrieval_bucket LIKE 'case_review%'",
    "topic_candidates": "is_topic_candidate",
    "topic_only": "is_topic_candidate AND NOT is_case_candidate",
}


def subset(classified: DataFrame, name: str) -> DataFrame:
    return classified.where(SUBSETS[name])


def sort_candidates(df: DataFrame) -> DataFrame:
    """The order of a published candidate list; columns that are not there are skipped."""
    up, down = ("country", "source", "retrieval_bucket"), ("relevance_score", "case_score", "topic_score", "text_length")
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in up if c in df.columns], *[F.col(c).desc_nulls_last() for c in down if c in df.columns])
