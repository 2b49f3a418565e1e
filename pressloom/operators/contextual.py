"""Contextual classification: direction of violence, evidence levels, case status.

Everything is one pass of Column expressions over the sentence windows of an
article; nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon, plain
from ..functions.text import let
from .matching import has, mark, shows, strings, terms_of
from .retrieval import DEATH, FEMALE, matched

# Names of levels, directions, labels and reasons, and the phrases that count as labels.
LEVELS = ("none", "low", "medium", "high")
GENDER_LABELS = (
    "asesinato por razones de genero",
    "crimen de genero",
    "mujeres asesinadas por razones de genero",
    "violencia basada en genero",
    "violencia contra la mujer",
    "violencia contra las mujeres",
    "violencia de genero",
    "violencia feminicida",
    "violencia hacia la mujer",
    "violencia hacia las mujeres",
    "violencia machista",
    "violencia por razones de genero",
)
DESCRIPTIONS = ("asesinatos de mujeres", "muerte violenta de mujeres", "muerte violenta de una mujer")
TITLES, BODIES = ("title_clean", "title", "title_raw"), ("text_clean", "text", "text_raw")
MOST_EVIDENCE = 10
DIRECTION_REASONS = {
    "mixed_or_conflicting": ("reverse_direction_pattern", "female_victim_pattern"),
    "female_to_male": ("female_aggressor_male_victim_pattern",),
    "male_to_female": ("direct_sexual_violence_against_female",),
    "female_victim_explicit": ("female_victim_grammatical_pattern",),
    "probable_male_to_female": ("female_sexual_violence_allegation_pattern",),
    "possible_male_victim": ("male_victim_pattern_without_clear_direction",),
}
#: The findings that a direction rests on.
DIRECTED = ("man attacked by her", "woman attacked", "woman raped", "woman accuses", "man as victim")
#: Group prefixes behind each fact of a window.
FACTS = {
    "female": FEMALE,
    "role": ("female_reference_terms.roles",),
    "violent": (DEATH + "violent_or_suspicious",),
    "ambiguous": (DEATH + "ambiguous_or_accidental",),
    "gone": ("indirect_terms.disappearance_phrases",),
    "injured": ("indirect_terms.injury_or_method_terms",),
    "crime": ("indirect_terms.generic_crime_terms",),
    "act": ("violence_types_and_modalities.acts",),
    "sexual": ("sexual_violence_terms", "violence_types_and_modalities.sexual"),
    "partner": ("relationship_terms.intimate_partner",),
    "family": ("relationship_terms.family_or_close_relation",),
    "aggressor": ("aggressor_terms.male_aggressor",),
    "prior": ("prior_violence_or_control_terms",),
    "accident": ("accident_or_disaster_terms.strong",),
}
TYPES = {"violent": "lethal_or_suspicious_death", "sexual": "sexual_violence", "gone": "disappearance", "injured": "physical_violence_or_method", "prior": "prior_violence_or_control"}


def direction(norm: Column) -> Column:
    """Who acts against whom in a normalized window, unknown without a pattern."""
    back, woman = shows(norm, "man attacked by her"), shows(norm, "woman attacked")
    return let(shows(norm, "woman raped"), lambda sexual: (
        F.when(back, F.when(woman | sexual, "mixed_or_conflicting").otherwise("female_to_male"))
        .when(sexual, "male_to_female").when(woman, "female_victim_explicit").when(shows(norm, "woman accuses"), "probable_male_to_female").otherwise("unknown")
    ))


def direction_with_victim(norm: Column) -> Column:
    """``direction``, but a man as victim where it is unknown."""
    return let(direction(norm), lambda d: F.when((d == "unknown") & shows(norm, "man as victim"), "possible_male_victim").otherwise(d))


def facts(window: Column, lexicon: Lexicon) -> Column:
    """Struct of booleans, the direction and the window itself."""
    by_group = {name: has(window["groups"], lexicon, *prefixes) for name, prefixes in FACTS.items()}

    def of(event: Column) -> Column:
        norm = window["head"]
        seen = by_group | {
            "violent": by_group["violent"] | event,
            "ambiguous": by_group["ambiguous"] | (~event & shows(norm, "death")),
            "gone": by_group["gone"] | shows(norm, "disappearance"),
            "sexual": by_group["sexual"] | shows(norm, "sexual violence"),
        }
        return F.struct(*[c.alias(k) for k, c in seen.items()], direction_with_victim(norm).alias("direction"), window.alias("window"))

    return let(shows(window["head"], "violent event"), of)


def is_strong(f: Column) -> Column:
    return f["violent"] | f["injured"] | f["act"] | f["sexual"]


def concerns_woman(f: Column) -> Column:
    """A female reference, or a female role with an event."""
    return f["female"] | (f["role"] & (is_strong(f) | f["gone"] | f["prior"]))


def verdict(f: Column) -> Column:
    """struct<level, reasons>: the first rule that fits, then the accident correction."""
    d, strong = f["direction"], is_strong(f)
    event = strong | f["gone"]
    against_her = d.isin("male_to_female", "female_victim_explicit")
    some = lambda *pairs: F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in pairs]))
    one = lambda r: F.array(F.lit(r))
    rules = (
        (d == "female_to_male", 0, one("reverse_direction_female_aggressor_male_victim")),
        (f["sexual"] & against_her, 3, one("sexual_violence_against_female_with_clear_direction")),
        (f["sexual"] & (d == "probable_male_to_female"), 2, one("sexual_violence_against_female_probable_direction")),
        (event & against_her & (f["partner"] | f["prior"]), 3, some((f["partner"], "female_victim_event_plus_intimate_partner"), (f["prior"], "female_victim_event_plus_prior_violence_or_control"))),
        (event & f["prior"] & (d != "possible_male_victim"), 3, one("female_event_plus_prior_violence_or_control")),
        (strong & f["aggressor"] & (against_her | (d == "probable_male_to_female")), 2, one("female_victim_event_plus_supported_male_aggressor")),
        (f["crime"] & f["partner"] & against_her, 2, one("female_victim_generic_crime_plus_intimate_partner")),
        (f["gone"] & (f["partner"] | f["prior"]), 2, one("female_disappearance_plus_contextual_relation")),
        (event | f["ambiguous"], 1, some(
            (F.lit(True), "female_event_without_sufficient_gender_context"), (f["partner"], "intimate_partner_term_without_clear_direction"),
            (f["family"], "family_or_close_relation_not_used_as_decisive_evidence"), (f["aggressor"], "male_aggressor_term_without_clear_direction"),
        )),
    )
    first = F.struct(F.lit(0).alias("level"), F.array().cast("array<string>").alias("reasons"))
    for condition, level, reasons in reversed(rules):
        first = F.when(condition, F.struct(F.lit(level).alias("level"), reasons.alias("reasons"))).otherwise(first)
    by_accident = lambda v: F.when(
        f["accident"] & (v["level"] > 0),
        F.struct(F.when(f["prior"], v["level"]).otherwise(1).alias("level"), F.concat(v["reasons"], one("possible_accident_or_disaster_context")).alias("reasons")),
    ).otherwise(v)
    return let(first, by_accident)


def evidence(windows: Column, lexicon: Lexicon) -> Column:
    """array<struct<level, reasons, direction, types, window>> of the windows that concern a woman, in order."""

    def item(f: Column) -> Column:
        types = F.array_sort(F.array_compact(F.array(*[F.when(f[k], F.lit(t)) for k, t in TYPES.items()])))
        return let(verdict(f), lambda v: F.struct(v["level"].alias("level"), F.array_sort(v["reasons"]).alias("reasons"), f["direction"].alias("direction"), types.alias("types"), f["window"].alias("window")))

    some = F.filter(windows, lambda w: has(w["groups"], lexicon, *FACTS["female"], *FACTS["role"]))
    return F.transform(F.filter(F.transform(some, lambda w: facts(w, lexicon)), concerns_woman), item)


def explicit_label(marks: Column, lexicon: Lexicon) -> tuple[Column, Column]:
    """(label, its terms) of a text with the terms of ``marks``."""
    kind = F.lit("none")
    shown = F.array().cast("array<string>")
    terms = lexicon.terms("direct_terms.high_precision")
    classes = (
        ("gendered_description", [t for t in terms if plain(t) in DESCRIPTIONS]),
        ("gender_violence", [t for t in terms if plain(t) in GENDER_LABELS]),
        ("femicide_feminicide", [t for t in terms if "femicid" in plain(t) or "feminicid" in plain(t)]),
    )
    for name, own in classes:
        if own:
            hits = F.array_compact(F.array(*[F.when(F.array_contains(marks, mark(t)), F.lit(t)) for t in sorted(set(own))]))
            there = F.arrays_overlap(marks, strings(map(mark, own)))
            kind, shown = F.when(there, name).otherwise(kind), F.when(there, hits).otherwise(shown)
    return kind, shown


def derived(bucket: Column, label: Column, level: Column) -> dict[str, Column]:
    """Recognition mode, status, priority and flags from bucket, label and level."""
    case = F.coalesce(bucket, F.lit("")).startswith("case_")
    named, close = label.isin("femicide_feminicide", "gender_violence"), level.isin("high", "medium")
    mode = (
        F.when(label == "femicide_feminicide", "explicit_femicide_feminicide").when(label == "gender_violence", "explicit_gender_violence").when(close, "contextual_without_explicit_label")
        .when(label == "gendered_description", "gendered_description_without_explicit_label").when(case, "ambiguous_case_without_explicit_label").otherwise("no_case_evidence")
    )
    status = (
        F.when(named, F.when(case | close, "candidate_explicit_case").otherwise("topic_explicit_not_case"))
        .when(level == "high", "candidate_contextual_high").when(level == "medium", "review_contextual_medium").when(case, "review_ambiguous_case").otherwise("not_selected")
    )
    priority = (
        F.when(status == "candidate_explicit_case", "P0_explicit_sample_only").when(status == "candidate_contextual_high", "P1_contextual_high")
        .when(status == "review_contextual_medium", "P2_contextual_medium").when(status == "review_ambiguous_case", "P3_ambiguous_case").otherwise("P4_not_selected")
    )
    return {
        "has_explicit_gender_label": named,
        "gender_recognition_mode": mode,
        "provisional_case_status": status,
        "review_priority": priority,
        "is_contextual_without_label": ~named & close,
        "analysis_case_candidate": status.isin("candidate_explicit_case", "candidate_contextual_high", "review_contextual_medium", "review_ambiguous_case"),
    }


def classify(df: DataFrame, lexicon: Lexicon, title: tuple[str, ...] = TITLES, body: tuple[str, ...] = BODIES, show_terms: bool = True) -> DataFrame:
    """Adds the contextual columns to rows with a ``retrieval_bucket``; without that column no row counts as a case.

    Windows that a retrieval scoring by the same lexicon has kept (``__m``) are not built again.
    """
    df = df if "__m" in df.columns else matched(df, lexicon, title, body)
    label, terms = explicit_label(F.col("__m.terms"), lexicon)
    df = df.withColumns({"explicit_label_type": label, "explicit_label_terms": terms, "__e": evidence(F.col("__m.windows"), lexicon)})
    df = df.withColumn("__best", F.coalesce(F.array_max(F.transform("__e", lambda e: e["level"])), F.lit(0)))
    # at no level at all, what was ruled out stays visible
    df = df.withColumn("__d", F.filter("__e", lambda e: (e["level"] == F.col("__best")) & ((F.col("__best") > 0) | (F.size(e["reasons"]) > 0))))
    union = lambda c, field: F.array_sort(F.array_distinct(F.flatten(F.transform(c, lambda e: e[field]))))
    df = df.withColumn("__way", F.array_distinct(F.filter(F.transform("__d", lambda e: e["direction"]), lambda d: d != "unknown")))
    df = df.withColumns({
        "contextual_evidence_level": F.get(F.array(*map(F.lit, LEVELS)), F.col("__best")),
        "contextual_score": F.col("__best"),
        "contextual_reasons": union("__d", "reasons"),
        "contextual_all_reasons": union("__e", "reasons"),
        "contextual_violence_types": union("__d", "types"),
        "violence_direction": F.when(F.size("__way") == 0, "unknown").when(F.size("__way") == 1, F.get("__way", F.lit(0))).otherwise("mixed"),
    })
    at_level = lambda k: F.filter("__e", lambda e: e["level"] == k)
    ordered = F.slice(F.concat(*map(at_level, (3, 2, 1, 0))), 1, MOST_EVIDENCE)
    told = F.create_map(*[x for d, reasons in DIRECTION_REASONS.items() for x in (F.lit(d), F.array(*map(F.lit, reasons)))])

    def shown(e: Column) -> Column:
        reasons = F.coalesce(F.element_at(told, e["direction"]), F.array().cast("array<string>"))
        matches = terms_of(e["window"]["terms"], lexicon).alias("matches") if show_terms else e["window"]["groups"].alias("groups")
        return F.struct(F.get(F.array(*map(F.lit, LEVELS)), e["level"]).alias("level"), e["reasons"].alias("reasons"), e["direction"].alias("direction"), reasons.alias("direction_reasons"), e["types"].alias("violence_types"), e["window"]["window_text"].alias("window_text"), matches)

    df = df.withColumn("contextual_evidence", F.transform(ordered, shown))
    bucket = F.col("retrieval_bucket") if "retrieval_bucket" in df.columns else F.lit("")
    df = df.withColumns(derived(bucket, F.col("explicit_label_type"), F.col("contextual_evidence_level")))
    if show_terms:
        df = df.withColumns({f"{c}_json": F.to_json(c) for c in ("explicit_label_terms", "contextual_reasons", "contextual_all_reasons", "contextual_violence_types", "contextual_evidence")})
    return df.drop("__m", "__e", "__best", "__d", "__way")
