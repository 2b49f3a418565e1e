"""The registered queries once more, as SQL for another engine (RE2 expressions, list functions).

One chain of common tables, from the fixture to the unique articles; each query
selects from it. Lexicon and patterns are the same values; the logic is written
anew.
"""

from __future__ import annotations

import re

from .functions import patterns as P
from .functions import text as X
from .functions import urls as U
from .functions.lexicon import Lexicon, plain
from .operators import contextual as K
from .operators import retrieval as R
from .operators import sampling
from .plans import fixtures

LEXICON = Lexicon.default()
W = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
EDGE = r"[^\pL\pM\pN\p{Pc}]"
START, END = 2015, 2019


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def norm(x: str) -> str:
    return strip(f"regexp_replace(lower(strip_accents(coalesce({x}, ''))), '{W}+', ' ', 'g')")


def spaces(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def repaired(x: str) -> str:
    """The letters that the fixture has broken."""
    return f"replace(coalesce({x}, ''), 'Ã±', 'ñ')"


def hit(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern.removeprefix('(?U)'))})"


def of_terms(column: str, terms) -> str:
    terms = sorted({plain(t) for t in terms})
    return hit(column, f"(^|{EDGE})(?:{'|'.join(map(re.escape, terms))})($|{EDGE})") if terms else "false"


def group(column: str, *prefixes: str) -> str:
    return of_terms(column, LEXICON.terms(*prefixes))


def kept_lines(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '{LINE}'), lambda s: {strip('s')}), lambda s: s <> '')"


FLIP = rf"regexp_replace(array_to_string(list_transform(regexp_split_to_array(coalesce(text, ''), '{LINE}'), lambda s: {strip('s')}), chr(10)), '(?m)^(?:-\n)?(?i:flipear)(?:\n[^\n]*)?(?:\n|\z)', '', 'g')"
CLEAN = spaces(f"array_to_string(list_filter({kept_lines('x')}, lambda s: NOT regexp_matches(lower(s), {q(X.DROPPED)})), chr(10))")
COMBOS = R.COMBOS
LABEL = lambda c: f"CASE WHEN {c} >= 8 THEN 'strong_candidate' WHEN {c} >= 5 THEN 'weak_candidate' WHEN {c} >= 3 THEN 'review_candidate' ELSE 'not_candidate' END"


def year(*columns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(CAST({c} AS VARCHAR), '^([0-9]{{4}})', 1), '')" for c in columns) + ")::INTEGER"


def trimmed(*columns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({strip(f'CAST({c} AS VARCHAR)')}, '')" for c in columns) + ", '')"


def windows(source: str) -> str:
    cut = rf"regexp_replace(t, '([.?!]){W}+', '\1' || chr(10), 'g')"
    return rf"""(SELECT doc_id, 2 * (i - 1) + k AS wid, CASE k WHEN 0 THEN s[i] ELSE s[i] || ' ' || s[i + 1] END AS w FROM
  (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({cut}, '\n+'), lambda s: {strip('s')}), lambda s: s <> '') AS s FROM {source})), range(0, 2) AS r(k) WHERE k = 0 OR i < len(s))"""


_female = group("n", *R.FEMALE)
_top = [t for t in LEXICON.terms("direct_terms.high_precision") if any(m in plain(t) for m in R.MOST_EXPLICIT)]
_ranked = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS rule, wid, accident, male, row_number() OVER (PARTITION BY doc_id ORDER BY wid) AS rn FROM rw WHERE female AND {name}" for name, *_ in COMBOS)
_reasons = ", ".join([
    "CASE WHEN top THEN 'explicit_femicide_or_gender_murder_term' WHEN direct THEN 'direct_gender_violence_term' END", "CASE WHEN structure THEN 'structural_gender_context' END",
    *[f"CASE WHEN on_{name} THEN '{reason}' END" for name, _, _, reason in COMBOS], "CASE WHEN any_accident THEN 'possible_accident_or_disaster_context' END", "CASE WHEN male_out THEN 'male_victim_context_exclusion' END",
])
_facts = {name: group("n", *prefixes) for name, prefixes in K.FACTS.items()}
_directions = f"""CASE WHEN {hit('n5', P.TO_MAN)} THEN CASE WHEN {hit('n5', P.TO_WOMAN)} OR {hit('n5', P.SEXUAL_TO_WOMAN)} THEN 'mixed_or_conflicting' ELSE 'female_to_male' END
  WHEN {hit('n5', P.SEXUAL_TO_WOMAN)} THEN 'male_to_female' WHEN {hit('n5', P.TO_WOMAN)} THEN 'female_victim_explicit' WHEN {hit('n5', P.SEXUAL_CLAIM)} THEN 'probable_male_to_female'
  WHEN {hit('n5', P.MALE_VICTIM)} THEN 'possible_male_victim' ELSE 'unknown' END"""
_labels = {
    "femicide_feminicide": [t for t in LEXICON.terms("direct_terms.high_precision") if "femicid" in plain(t) or "feminicid" in plain(t)],
    "gender_violence": [t for t in LEXICON.terms("direct_terms.high_precision") if plain(t) in K.GENDER_LABELS],
    "gendered_description": [t for t in LEXICON.terms("direct_terms.high_precision") if plain(t) in K.DESCRIPTIONS],
}
_terms = ", ".join(f"({q(g)}, {q(t)}, {q(f'(^|{EDGE})(?:{re.escape(plain(t))})($|{EDGE})')})" for g, ts in LEXICON.groups.items() for t in sorted(set(ts)))
_order = " ".join(f"WHEN '{name}' THEN {k}" for k, (name, *_) in enumerate(COMBOS))
_why = """CASE WHEN way = 'female_to_male' THEN ['reverse_direction_female_aggressor_male_victim'] WHEN sexual AND at_her THEN ['sexual_violence_against_female_with_clear_direction'] WHEN sexual AND way = 'probable_male_to_female' THEN ['sexual_violence_against_female_probable_direction']
  WHEN (strong OR gone) AND at_her AND (partner OR prior) THEN [CASE WHEN partner THEN 'female_victim_event_plus_intimate_partner' END, CASE WHEN prior THEN 'female_victim_event_plus_prior_violence_or_control' END]
  WHEN (strong OR gone) AND prior AND way <> 'possible_male_victim' THEN ['female_event_plus_prior_violence_or_control'] WHEN strong AND aggressor AND (at_her OR way = 'probable_male_to_female') THEN ['female_victim_event_plus_supported_male_aggressor']
  WHEN crime AND partner AND at_her THEN ['female_victim_generic_crime_plus_intimate_partner'] WHEN gone AND (partner OR prior) THEN ['female_disappearance_plus_contextual_relation']
  WHEN strong OR gone OR ambiguous THEN ['female_event_without_sufficient_gender_context', CASE WHEN partner THEN 'intimate_partner_term_without_clear_direction' END, CASE WHEN family THEN 'family_or_close_relation_not_used_as_decisive_evidence' END, CASE WHEN aggressor THEN 'male_aggressor_term_without_clear_direction' END]
  ELSE [] END"""
_case = "retrieval_bucket LIKE 'case\\_%' ESCAPE '\\'"
_named = "explicit_label_type IN ('femicide_feminicide', 'gender_violence')"
_close = "contextual_evidence_level IN ('high', 'medium')"
_rank = {"candidate_explicit_case": 5, "candidate_contextual_high": 4, "review_contextual_medium": 3, "review_ambiguous_case": 2, "topic_explicit_not_case": 1, "not_selected": 0}
CATEGORY = "CASE WHEN retrieval_bucket IN ('case_strong', 'not_candidate') THEN retrieval_bucket WHEN starts_with(retrieval_bucket, 'case_review') THEN 'case_review' WHEN starts_with(retrieval_bucket, 'topic') THEN 'topic' ELSE 'other' END"

CHAIN = {
    "art": fixtures.plain(fixtures.ARTICLES),
    "cl": f"SELECT * EXCLUDE (text, title, x), {CLEAN} AS text, {spaces(repaired('title'))} AS title FROM (SELECT *, CASE WHEN source = 'eluniversal_mx' THEN {FLIP} ELSE coalesce(text, '') END AS x FROM art)",
    "tx": f"SELECT *, {norm('t')} AS n FROM (SELECT *, coalesce(anchor_text, '') || chr(10) || title || chr(10) || substr(text, 1, 2500) AS t FROM cl)",
    "gl": f"SELECT doc_id, {of_terms('n', _top)} AS top, {group('n', 'direct_terms.high_precision')} AS direct, {group('n', 'structural_context_terms')} AS structure FROM tx",
    "wn": f"SELECT * FROM (SELECT doc_id, wid, w, {norm('w')} AS n, {norm('substr(w, 1, 500)')} AS n5 FROM {windows('tx')}) WHERE NOT {hit('n', X.FURNITURE)}",
    "rw": f"SELECT doc_id, wid, {_female} AS female, " + ", ".join(f"{group('n', *groups)} AS {name}" for name, groups, *_ in COMBOS) + f", {group('n', 'accident_or_disaster_terms.strong')} AS accident, {hit('n5', P.MALE_VICTIM)} AS male FROM wn",
    "ev": f"SELECT * FROM ({_ranked}) WHERE rn <= 3",
    "es": "SELECT doc_id, " + ", ".join(f"bool_or(rule = '{name}') AS on_{name}" for name, *_ in COMBOS) + ", bool_or(accident) AS any_accident, bool_or(male) AS any_male FROM ev GROUP BY doc_id",
    "rb": """SELECT *, on_violent OR top AS strong, CASE WHEN top OR on_violent THEN 'case_strong' WHEN on_injured THEN 'case_review_possible_violence' WHEN on_gone THEN 'case_review_female_disappearance' WHEN direct THEN 'topic_gender_violence'
  WHEN structure THEN 'topic_gender_violence' WHEN on_dead THEN 'case_review_female_death' WHEN on_topic THEN 'topic_gender_violence' ELSE 'not_candidate' END AS bucket,
  greatest(CASE WHEN top THEN 12 ELSE 0 END, CASE WHEN on_violent THEN 10 ELSE 0 END, CASE WHEN on_gone THEN 7 ELSE 0 END, CASE WHEN on_injured THEN 6 ELSE 0 END, CASE WHEN on_dead THEN 4 ELSE 0 END) AS score,
  greatest(CASE WHEN direct THEN 10 ELSE 0 END, CASE WHEN structure THEN 5 ELSE 0 END, CASE WHEN on_topic THEN 4 ELSE 0 END) AS topic_score
  FROM (SELECT gl.*, """ + ", ".join(f"coalesce({c}, false) AS {c}" for c in [*[f"on_{n}" for n, *_ in COMBOS], "any_accident", "any_male"]) + " FROM gl LEFT JOIN es ON gl.doc_id = es.doc_id)",
    "rs": f"""SELECT *, {LABEL('case_score')} AS case_label, {LABEL('topic_score')} AS topic_label FROM (SELECT *, CASE WHEN male_out THEN 0 ELSE score END AS case_score, CASE WHEN male_out THEN 'not_candidate' ELSE bucket END AS retrieval_bucket
  FROM (SELECT *, bucket LIKE 'case\\_review%' ESCAPE '\\' AND any_male AS male_out FROM rb))""",
    "cs": f"""SELECT cl.*, rs.* EXCLUDE (doc_id), {_case} AS is_case_candidate, topic_label <> 'not_candidate' AS is_topic_candidate, greatest(case_score, topic_score) AS relevance_score, array_to_string(list_sort(list_filter([{_reasons}], lambda r: r IS NOT NULL)), ',') AS reasons
  FROM cl JOIN rs ON cl.doc_id = rs.doc_id""",
    "cf": "SELECT doc_id, wid, " + ", ".join(f"{sql} AS {name}" for name, sql in _facts.items()) + f", {hit('n5', P.VIOLENT)} AS event_text, {hit('n5', P.DEATH)} AS death_text, {hit('n5', P.GONE)} AS gone_text, {hit('n5', P.SEXUAL)} AS sexual_text, {_directions} AS way, {of_terms('n', {t for ts in LEXICON.groups.values() for t in ts})} AS any_group FROM wn",
    "cw": """SELECT *, violent OR injured OR act OR sexual AS strong, way IN ('male_to_female', 'female_victim_explicit') AS at_her FROM (SELECT doc_id, wid, female, role, violent OR event_text AS violent, ambiguous OR (death_text AND NOT event_text) AS ambiguous, gone OR gone_text AS gone, injured, crime, act,
  sexual OR sexual_text AS sexual, partner, family, aggressor, prior, accident, way FROM cf WHERE any_group)""",
    "cv": """SELECT *, CASE WHEN accident AND raw > 0 AND NOT prior THEN 1 ELSE raw END AS level FROM (SELECT *, CASE WHEN way = 'female_to_male' THEN 0 WHEN sexual AND at_her THEN 3 WHEN sexual AND way = 'probable_male_to_female' THEN 2
  WHEN (strong OR gone) AND at_her AND (partner OR prior) THEN 3 WHEN (strong OR gone) AND prior AND way <> 'possible_male_victim' THEN 3 WHEN strong AND aggressor AND (at_her OR way = 'probable_male_to_female') THEN 2
  WHEN crime AND partner AND at_her THEN 2 WHEN gone AND (partner OR prior) THEN 2 WHEN strong OR gone OR ambiguous THEN 1 ELSE 0 END AS raw FROM cw WHERE female OR (role AND (strong OR gone OR prior)))""",
    "mt": f"SELECT doc_id, g, t FROM tx, (VALUES {_terms}) AS l(g, t, p) WHERE regexp_matches(n, p)",
    "mw": f"SELECT doc_id, wid, string_agg(g || ':' || t, ',' ORDER BY g || ':' || t) AS matches FROM wn, (VALUES {_terms}) AS l(g, t, p) WHERE regexp_matches(n, p) GROUP BY doc_id, wid",
    "ce": f"SELECT *, list_sort(list_filter(list_append({_why}, CASE WHEN accident AND raw > 0 THEN 'possible_accident_or_disaster_context' END), lambda x: x IS NOT NULL)) AS why, row_number() OVER (PARTITION BY doc_id ORDER BY level DESC, wid) - 1 AS place FROM cv",
    "cb": "SELECT doc_id, max(level) AS best FROM cv GROUP BY doc_id",
    "cd": """SELECT cv.doc_id, best, array_to_string(list_sort(list_distinct(list(way) FILTER (WHERE way <> 'unknown'))), ',') AS ways,
  array_to_string(list_filter([CASE WHEN bool_or(gone) THEN 'disappearance' END, CASE WHEN bool_or(violent) THEN 'lethal_or_suspicious_death' END, CASE WHEN bool_or(injured) THEN 'physical_violence_or_method' END, CASE WHEN bool_or(prior) THEN 'prior_violence_or_control' END, CASE WHEN bool_or(sexual) THEN 'sexual_violence' END], lambda x: x IS NOT NULL), ',') AS types
  FROM cv JOIN cb ON cv.doc_id = cb.doc_id WHERE level = best AND (best > 0 OR way = 'female_to_male') GROUP BY cv.doc_id, best""",
    "cx": f"""SELECT cs.*, {year('cs.snapshot_timestamp', 'cs.run_id')} AS archive_year, try_strptime(nullif(regexp_extract(coalesce(cs.snapshot_timestamp, ''), '^([0-9]{{14}})', 1), ''), '%Y%m%d%H%M%S') AS snapshot_datetime,
  CASE WHEN {of_terms('tx.n', _labels['femicide_feminicide'])} THEN 'femicide_feminicide' WHEN {of_terms('tx.n', _labels['gender_violence'])} THEN 'gender_violence' WHEN {of_terms('tx.n', _labels['gendered_description'])} THEN 'gendered_description' ELSE 'none' END AS explicit_label_type,
  coalesce(cb.best, 0) AS contextual_score, ['none', 'low', 'medium', 'high'][coalesce(cb.best, 0) + 1] AS contextual_evidence_level, CASE WHEN coalesce(ways, '') = '' THEN 'unknown' WHEN contains(ways, ',') THEN 'mixed' ELSE ways END AS violence_direction, coalesce(types, '') AS types,
  {trimmed('cs.normalized_url', 'cs.candidate_url')} AS _article_url
  FROM cs JOIN tx ON cs.doc_id = tx.doc_id LEFT JOIN cb ON cs.doc_id = cb.doc_id LEFT JOIN cd ON cs.doc_id = cd.doc_id""",
    "sn": f"""SELECT *, CASE WHEN explicit_label_type = 'femicide_feminicide' THEN 'explicit_femicide_feminicide' WHEN explicit_label_type = 'gender_violence' THEN 'explicit_gender_violence' WHEN {_close} THEN 'contextual_without_explicit_label'
  WHEN explicit_label_type = 'gendered_description' THEN 'gendered_description_without_explicit_label' WHEN {_case} THEN 'ambiguous_case_without_explicit_label' ELSE 'no_case_evidence' END AS gender_recognition_mode,
  CASE WHEN {_named} AND ({_case} OR {_close}) THEN 'candidate_explicit_case' WHEN {_named} THEN 'topic_explicit_not_case' WHEN contextual_evidence_level = 'high' THEN 'candidate_contextual_high' WHEN contextual_evidence_level = 'medium' THEN 'review_contextual_medium'
  WHEN {_case} THEN 'review_ambiguous_case' ELSE 'not_selected' END AS provisional_case_status, length(text) AS n_text,
  CASE WHEN _article_url = '' THEN run_id || '|row|' || doc_id ELSE {trimmed('country')} || '|' || source || '|' || _article_url END AS _article_key FROM cx WHERE archive_year BETWEEN {START} AND {END}""",
    "un": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_year, _article_key ORDER BY CASE provisional_case_status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _rank.items()) + " END DESC, contextual_score DESC, n_text DESC, doc_id) AS rn, count(*) OVER w AS snapshot_count, min(snapshot_datetime) OVER w AS first_snapshot_datetime, max(snapshot_datetime) OVER w AS last_snapshot_datetime FROM sn WINDOW w AS (PARTITION BY archive_year, _article_key)) WHERE rn = 1",
    "ca": f"SELECT *, {CATEGORY} AS main_category FROM sn",
    "nw": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_year, _article_key ORDER BY CASE main_category WHEN 'case_strong' THEN 4 WHEN 'case_review' THEN 3 WHEN 'topic' THEN 2 WHEN 'not_candidate' THEN 1 ELSE 0 END DESC, doc_id) AS rn FROM ca) WHERE rn = 1",
    "de": f"SELECT article_key, arg_max(lower({strip('manual_scope_decision')}), ordinal) AS manual_scope_decision FROM ({fixtures.plain(fixtures.DECISIONS)}) GROUP BY article_key",
    "fc": f"""SELECT un.*, {trimmed('un.normalized_url', 'un.candidate_url')} AS url_key, {norm("title || chr(10) || coalesce(anchor_text, '') || chr(10) || substr(text, 1, 4000)")} AS an FROM un WHERE provisional_case_status NOT IN ('topic_explicit_not_case', 'not_selected')""",
    "fk": f"""SELECT * EXCLUDE (an), CASE WHEN url_key <> '' THEN url_key ELSE 'fallback|' || source || '|' || archive_year || '|' || title END AS article_key, CASE WHEN violence_direction = 'female_to_male' THEN 'female_aggressor_male_victim' WHEN {hit('an', P.CLEAR_TO_MAN)} THEN 'possible_female_aggressor_male_victim'
  WHEN {hit('an', P.CLEAR_TO_WOMAN)} THEN 'possible_female_aggressor_female_victim' WHEN {hit('an', P.POSSIBLY_HER)} THEN 'possible_female_aggressor' ELSE '' END AS auto_scope_reason FROM fc""",
    "fd": "SELECT fk.*, coalesce(de.manual_scope_decision, '') AS manual_scope_decision, CASE WHEN auto_scope_reason = '' THEN 'no_alert' ELSE 'alert' END AS auto_scope_status FROM fk LEFT JOIN de ON fk.article_key = de.article_key",
    "cr": "SELECT ce.doc_id, array_to_string(list_sort(list_distinct(flatten(list(why) FILTER (WHERE level = best)))), ',') AS at_best, array_to_string(list_sort(list_distinct(flatten(list(why)))), ',') AS at_all FROM ce JOIN cb ON ce.doc_id = cb.doc_id GROUP BY ce.doc_id",
    "hs": f"SELECT DISTINCT doc_id FROM mt WHERE regexp_matches(lower(g || ' ' || t), '{sampling.HARD}') UNION SELECT doc_id FROM cr WHERE regexp_matches(at_best, '{sampling.HARD}')",
    "hp": f"SELECT *, regexp_matches(lower(title || ' ' || coalesce(anchor_text, '') || ' ' || reasons), '{sampling.HARD}') OR doc_id IN (SELECT doc_id FROM hs) AS hard FROM un WHERE provisional_case_status = 'not_selected' AND retrieval_bucket = 'not_candidate'",
    "hn": "SELECT * FROM hp WHERE hard OR NOT (SELECT bool_or(hard) FROM hp)",
    "po": "SELECT validation_group, archive_year, country, source, doc_id FROM (SELECT un.*, CASE provisional_case_status " + " ".join(f"WHEN '{s}' THEN '{g}'" for g, s in sampling.STATUS.items()) + " END AS validation_group FROM un) WHERE validation_group IS NOT NULL UNION ALL SELECT 'hard_negative', archive_year, country, source, doc_id FROM hn",
    "cn": fixtures.plain(fixtures.CANDIDATES),
    "cp": fixtures.plain(fixtures.CAPTURES),
    "rv": fixtures.plain(fixtures.REVIEWED),
    "rl": f"SELECT validation_group, lower({strip('coalesce(manual_case_label, $$$$)')}) AS l, lower({strip('coalesce(manual_gender_recognition, $$$$)')}) AS g, coalesce(try_cast(sample_weight AS DOUBLE), 1.0) AS w FROM rv",
}


def needed(sql: str) -> list[str]:
    """The common tables that a statement rests on, in order."""
    names: set[str] = set()

    def walk(text: str) -> None:
        for name in CHAIN:
            if name not in names and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                names.add(name)
                walk(CHAIN[name])

    walk(sql)
    return [n for n in CHAIN if n in names]


def full(sql: str) -> str:
    names = needed(sql)
    sql = sql.replace("count_if(", "count(*) FILTER (WHERE ")
    return ("WITH " + ",\n".join(f"{n} AS ({CHAIN[n]})" for n in names) + "\n" if names else "") + sql


def url_part(u: str, k: int) -> str:
    return f"regexp_extract(coalesce({u}, ''), '(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#;]*)', {k})"


def no_article(u: str) -> str:
    low = f"lower({strip(f'coalesce({u}, $$$$)')})"
    path = f"regexp_replace({url_part(low, 3)}, '/+$', '')"
    return rf"({low} = '' OR regexp_matches({low}, {q(X.quoted(U.NO_ARTICLE))}) OR regexp_matches({path}, '\.(?:{U.FILES.replace(' ', '|')})$') OR {path} IN ('', '/', '/home', '/index.html'))"


def like_article(u: str, anchor: str) -> str:
    path = f"regexp_replace({url_part(strip(f'coalesce({u}, $$$$)'), 3)}, '/+$', '')"
    words = strip(f"coalesce({anchor}, '')")
    menu = ", ".join(q(w) for w in U.MENU.split("|"))
    return f"(NOT {no_article(u)} AND length({path}) - length(replace({path}, '/', '')) >= 2 AND length({words}) >= 10 AND lower({words}) NOT IN ({menu}))"


def normal_url(u: str) -> str:
    host = f"replace(lower(regexp_replace(regexp_replace({url_part(u, 2)}, '^.*@', ''), ':[0-9]*$', '')), 'www.', '')"
    path = f"regexp_replace({url_part(u, 3)}, '/+$', '')"
    return f"CASE WHEN {host} = '' THEN 'http:' || CASE WHEN starts_with({path}, '/') OR {path} = '' THEN '//' ELSE '///' END || {path} ELSE 'http://' || {host} || CASE WHEN {path} <> '' AND NOT starts_with({path}, '/') THEN '/' ELSE '' END || {path} END"


def wilson(s: str, n: str) -> tuple[str, str]:
    z = 1.96
    p, b = f"({s}::DOUBLE / nullif({n}, 0))", f"(1 + {z * z!r}::DOUBLE / {n})"
    centre, margin = f"({p} + {z * z!r}::DOUBLE / (2 * {n})) / {b}", f"{z}::DOUBLE * sqrt(({p} * (1 - {p}) + {z * z!r}::DOUBLE / (4 * {n})) / {n}) / {b}"
    return f"CASE WHEN {n} > 0 THEN round(greatest(0.0::DOUBLE, {centre} - {margin}), 9) END", f"CASE WHEN {n} > 0 THEN round(least(1.0::DOUBLE, {centre} + {margin}), 9) END"


CHAIN["cc"] = f"SELECT source, normalized_url, candidate_url FROM (SELECT *, row_number() OVER (PARTITION BY source, normalized_url ORDER BY snapshot_timestamp, candidate_url) AS rn FROM (SELECT *, {normal_url('candidate_url')} AS normalized_url FROM cn WHERE {like_article('candidate_url', 'anchor_text')}) WHERE NOT {no_article('normalized_url')}) WHERE rn = 1"
_low, _high = wilson("n_relevant", "(n_relevant + n_not_relevant)")
_statuses = ", ".join(f"count_if(provisional_case_status = '{s}') AS {s}" for s in _rank)
_main = "provisional_case_status IN ('candidate_explicit_case', 'candidate_contextual_high') AND manual_scope_decision <> 'exclude'"
_pending = "((auto_scope_status = 'alert' AND manual_scope_decision = '') OR manual_scope_decision = 'review')"
_stage = "SELECT 'cdx_snapshots' AS stage, source, false AS txt, false AS bad FROM cp UNION ALL SELECT 'homepage_candidates', source, false, false FROM cn UNION ALL SELECT 'clean_candidates', source, false, false FROM cc UNION ALL SELECT 'articles_text', source, length(coalesce(text, '')) > 0, fetch_error IS NOT NULL FROM art UNION ALL SELECT 'articles_classified', source, false, false FROM art WHERE fetch_error IS NULL"
_counts = "count_if(stage = 'cdx_snapshots') AS cdx_snapshots, count_if(stage = 'homepage_candidates') AS homepage_candidates, count_if(stage = 'clean_candidates') AS clean_candidates, count_if(stage = 'articles_text') AS articles_text, count_if(stage = 'articles_text' AND txt) AS articles_with_text, count_if(stage = 'articles_text' AND bad) AS fetch_or_parse_errors, count_if(stage = 'articles_classified') AS articles_classified"
PLACE = "archive_year, country, source"
_wide = lambda key, column, values: f"SELECT {key}, " + ", ".join(f"count_if({column} = '{v}') AS {v}" for v in values) + " FROM {} GROUP BY {}"

QUERIES = {
    "matched_terms": "SELECT doc_id, g AS matched_group, string_agg(t, ',' ORDER BY t) AS terms FROM mt GROUP BY doc_id, g",
    "proximity_evidence": f"""SELECT p.doc_id, p.place, p.wid::BIGINT AS window_id, md5(substr(w, 1, 500)) AS text_md5, matches FROM (SELECT doc_id, wid, row_number() OVER (PARTITION BY doc_id ORDER BY CASE rule {_order} END, wid) - 1 AS place FROM ev) AS p
  JOIN wn ON p.doc_id = wn.doc_id AND p.wid = wn.wid JOIN mw ON p.doc_id = mw.doc_id AND p.wid = mw.wid WHERE place < {R.EVIDENCE}""",
    "contextual_evidence": f"""SELECT sn.doc_id, ce.place, CASE level WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS level, array_to_string(why, ',') AS reasons, way AS direction,
  array_to_string(list_filter([CASE WHEN gone THEN 'disappearance' END, CASE WHEN violent THEN 'lethal_or_suspicious_death' END, CASE WHEN injured THEN 'physical_violence_or_method' END, CASE WHEN prior THEN 'prior_violence_or_control' END, CASE WHEN sexual THEN 'sexual_violence' END], lambda x: x IS NOT NULL), ',') AS types,
  md5(substr(w, 1, 500)) AS text_md5, matches FROM ce JOIN sn ON ce.doc_id = sn.doc_id JOIN wn ON ce.doc_id = wn.doc_id AND ce.wid = wn.wid JOIN mw ON ce.doc_id = mw.doc_id AND ce.wid = mw.wid WHERE place < {K.MOST_EVIDENCE}""",
    "contextual_reasons": f"""SELECT sn.doc_id, coalesce(at_best, '') AS reasons, coalesce(at_all, '') AS all_reasons, coalesce(label_terms, '') AS label_terms FROM sn LEFT JOIN cr ON sn.doc_id = cr.doc_id
  LEFT JOIN (SELECT mt.doc_id, string_agg(t, ',' ORDER BY t) AS label_terms FROM mt JOIN sn ON mt.doc_id = sn.doc_id WHERE g = 'direct_terms.high_precision' AND CASE explicit_label_type {" ".join(f"WHEN '{k}' THEN t IN ({', '.join(map(q, v)) or 'NULL'})" for k, v in _labels.items())} ELSE false END GROUP BY mt.doc_id) AS lt ON sn.doc_id = lt.doc_id""",
    "normalize_text": f"SELECT doc_id, md5({norm('text')}) AS norm_md5 FROM art",
    "clean_text": f"SELECT doc_id, title AS title_clean, md5(text) AS text_md5, length(text) AS n FROM cl",
    "sentence_windows": "SELECT doc_id, count(*) AS n_windows, sum(length(w))::BIGINT AS n_chars, max(wid)::BIGINT AS last_id FROM wa GROUP BY doc_id".replace("wa", windows("tx") + " wa"),
    "lexicon_match_global": "SELECT doc_id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {group('n', g)} THEN '{g}' END" for g in sorted(LEXICON.groups)) + "], lambda g: g IS NOT NULL)), ',') AS groups FROM tx",
    "lexicon_match_window": "SELECT doc_id, count(*) AS n_windows, sum(wid)::BIGINT AS ids, count_if(female) AS n_female, count_if(violent) AS n_violent, count_if(accident) AS n_accident FROM cf WHERE any_group GROUP BY doc_id",
    "retrieval_score": "SELECT doc_id, case_score::BIGINT AS case_score, topic_score::BIGINT AS topic_score, relevance_score::BIGINT AS relevance_score, case_label, topic_label, retrieval_bucket, is_case_candidate, is_topic_candidate, is_case_candidate OR is_topic_candidate AS is_retrieval_candidate, reasons, CASE WHEN retrieval_bucket = 'case_strong' THEN 'strong_candidate' WHEN retrieval_bucket LIKE 'case_review%' THEN 'review_candidate' WHEN retrieval_bucket LIKE 'topic%' THEN 'weak_candidate' ELSE 'not_candidate' END AS candidate_label, CASE WHEN is_case_candidate AND is_topic_candidate THEN 'case_and_topic' WHEN is_case_candidate THEN 'case' WHEN is_topic_candidate THEN 'topic' ELSE 'none' END AS candidate_type FROM cs",
    "retrieval_bucket_counts": "SELECT retrieval_bucket, count(*) AS n_articles FROM cs GROUP BY 1",
    "retrieval_subsets": "SELECT s AS subset, n FROM (SELECT unnest([{'s': 'candidates', 'n': count_if(is_case_candidate OR is_topic_candidate)}, {'s': 'case_candidates', 'n': count_if(is_case_candidate)}, {'s': 'strong_cases', 'n': count_if(retrieval_bucket = 'case_strong')}, {'s': 'review_cases', 'n': count_if(retrieval_bucket LIKE 'case_review%')}, {'s': 'topic_candidates', 'n': count_if(is_topic_candidate)}, {'s': 'topic_only', 'n': count_if(is_topic_candidate AND NOT is_case_candidate)}], recursive := true) FROM cs)",
    "male_victim_flag": "SELECT doc_id, count_if(male) AS n_male, count(*) AS n_windows FROM rw GROUP BY doc_id",
    "explicit_label": "SELECT doc_id, explicit_label_type FROM cx",
    "violence_direction": f"SELECT way AS direction, count(*) AS n_windows FROM (SELECT {_directions} AS way FROM wn) GROUP BY 1",
    "contextual_level": "SELECT doc_id, contextual_evidence_level, contextual_score::BIGINT AS contextual_score, violence_direction, types FROM sn",
    "case_status": f"SELECT doc_id, gender_recognition_mode, provisional_case_status, {_named} AS has_explicit_gender_label, NOT {_named} AND {_close} AS is_contextual_without_label FROM sn",
    "scope_alert": "SELECT doc_id, auto_scope_status, auto_scope_reason FROM fd",
    "manual_decisions_join": "SELECT doc_id, article_key, manual_scope_decision FROM fd",
    "final_corpus_summary": f"SELECT count(*) AS all_contextual_candidates, count_if({_main}) AS main_case_articles, count_if(provisional_case_status = 'review_contextual_medium' AND manual_scope_decision <> 'exclude') AS sensitivity_medium_articles, count_if(provisional_case_status = 'review_ambiguous_case' AND manual_scope_decision <> 'exclude') AS ambiguous_articles, count_if(manual_scope_decision = 'exclude') AS manual_exclusions, count_if(manual_scope_decision = 'include') AS manual_inclusions, count_if({_pending}) AS pending_scope_alerts FROM fd",
    "main_distribution": f"SELECT provisional_case_status, gender_recognition_mode, count(*) AS n_articles FROM fd WHERE {_main} GROUP BY 1, 2",
    "exclusion_summary": "SELECT provisional_case_status, auto_scope_reason, count(*) AS n_articles FROM fd WHERE manual_scope_decision = 'exclude' GROUP BY 1, 2",
    "pending_decisions": "SELECT doc_id, article_key, auto_scope_reason FROM fd WHERE auto_scope_status = 'alert' AND manual_scope_decision = ''",
    "normalize_url": f"SELECT page_id, {normal_url('candidate_url')} AS normalized_url FROM cn",
    "url_filter": f"SELECT page_id, {no_article('candidate_url')} AS no_article, {like_article('candidate_url', 'anchor_text')} AS looks_like_article FROM cn",
    "clean_candidates": "SELECT source, normalized_url, candidate_url FROM cc",
    "wayback_url": "SELECT page_id, 'https://web.archive.org/web/' || snapshot_timestamp || 'id_/' || candidate_url AS raw_url, snapshot_timestamp || '_' || md5(candidate_url) || '.html' AS cache_name FROM cn",
    "wayback_unwrap": "SELECT page_id, url AS href FROM pages",
    "link_extract": r"""SELECT 'press' AS source, 'Argentina' AS country, snapshot_timestamp, homepage_url, candidate_url, anchor_text FROM (SELECT *, row_number() OVER (PARTITION BY candidate_url ORDER BY snapshot_timestamp) AS rn FROM
  (SELECT lpad(CAST(page_id AS VARCHAR), 14, '0') AS snapshot_timestamp, url AS homepage_url, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS candidate_url, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS anchor_text FROM pages)) WHERE rn = 1""",
    "archive_year": f"SELECT doc_id, {year('snapshot_timestamp', 'run_id')} AS archive_year FROM art",
    "snapshot_datetime": "SELECT doc_id, CAST(try_strptime(nullif(regexp_extract(coalesce(snapshot_timestamp, ''), '^([0-9]{14})', 1), ''), '%Y%m%d%H%M%S') AS VARCHAR) AS captured FROM art",
    "article_key": f"SELECT doc_id, CASE WHEN u = '' THEN run_id || '|row|' || doc_id ELSE {trimmed('country')} || '|' || source || '|' || u END AS article_key FROM (SELECT *, {trimmed('normalized_url', 'candidate_url')} AS u FROM art)",
    "dedup_news": "SELECT archive_year, _article_key, doc_id, main_category FROM nw",
    "dedup_articles": "SELECT archive_year, _article_key, doc_id, provisional_case_status FROM un",
    "snapshot_stats": "SELECT archive_year, _article_key, snapshot_count, CAST(first_snapshot_datetime AS VARCHAR) AS first_captured, CAST(last_snapshot_datetime AS VARCHAR) AS last_captured FROM un",
    "year_bucket_long": "SELECT archive_year, retrieval_bucket, count(*) AS n_unique_news FROM nw GROUP BY 1, 2",
    "year_bucket_wide": _wide("archive_year", "retrieval_bucket", ("case_strong", "case_review_female_disappearance", "case_review_possible_violence", "case_review_female_death", "topic_gender_violence", "topic_policy_or_prevention", "not_candidate")).format("nw", "archive_year"),
    "main_category_year": "SELECT archive_year, count_if(main_category = 'case_strong') AS case_strong, count_if(main_category = 'case_review') AS case_review, count_if(main_category IN ('case_strong', 'case_review')) AS all_case_candidates, count_if(main_category = 'topic') AS topic, count_if(main_category = 'not_candidate') AS not_candidate, count_if(main_category = 'other') AS other, count(*) AS total_unique_news FROM nw GROUP BY 1",
    "news_by_source": f"SELECT {PLACE}, retrieval_bucket, count(*) AS n_unique_news FROM nw GROUP BY ALL",
    "coverage": f"SELECT *, round((case_strong + case_review)::DOUBLE / nullif(total_unique_news, 0), 9) AS case_candidate_rate FROM (SELECT {PLACE}, count(DISTINCT _article_key) AS total_unique_news, count_if(main_category = 'case_strong') AS case_strong, count_if(main_category = 'case_review') AS case_review, count_if(main_category = 'topic') AS topic FROM nw GROUP BY ALL)",
    "contextual_coverage": f"SELECT *, round((contextual_high + contextual_medium)::DOUBLE / nullif(total_unique_news, 0), 9) AS implicit_candidate_rate FROM (SELECT {PLACE}, count(DISTINCT _article_key) AS total_unique_news, count_if(provisional_case_status = 'candidate_explicit_case') AS explicit_case_candidates, count_if(provisional_case_status = 'candidate_contextual_high') AS contextual_high, count_if(provisional_case_status = 'review_contextual_medium') AS contextual_medium, count_if(provisional_case_status = 'review_ambiguous_case') AS ambiguous_cases FROM un GROUP BY ALL)",
    "crosstab_bucket_status": _wide("retrieval_bucket", "provisional_case_status", _rank).format("un", "retrieval_bucket"),
    "crosstab_status_recognition": _wide("provisional_case_status", "gender_recognition_mode", ("explicit_femicide_feminicide", "explicit_gender_violence", "contextual_without_explicit_label", "gendered_description_without_explicit_label", "ambiguous_case_without_explicit_label", "no_case_evidence")).format("un", "provisional_case_status"),
    "crosstab_bucket_level": _wide("retrieval_bucket", "contextual_evidence_level", ("none", "low", "medium", "high")).format("un", "retrieval_bucket"),
    "long_summary": f"SELECT {PLACE}, gender_recognition_mode, count(*) AS n_unique_news FROM un GROUP BY ALL",
    "status_by_source": f"SELECT {PLACE}, provisional_case_status, count(*) AS n_unique_news FROM un GROUP BY ALL",
    "without_label": f"SELECT doc_id, provisional_case_status FROM un WHERE NOT {_named} AND {_close}",
    "review_queue": "SELECT archive_year, country, source, provisional_case_status, normalized_url, '' AS manual_case_label FROM un WHERE provisional_case_status IN ('candidate_contextual_high', 'review_contextual_medium', 'review_ambiguous_case')",
    "classification_audit": f"SELECT {START} AS start_year, {END} AS end_year, sum(snapshot_count)::BIGINT AS snapshot_rows, count(*) AS unique_article_year_rows, (sum(snapshot_count) - count(*))::BIGINT AS duplicate_snapshots_collapsed_for_counts, {_statuses}, count_if(violence_direction = 'female_to_male') AS reverse_direction_detected, count_if(violence_direction = 'possible_male_victim') AS possible_male_victim_detected, count_if(violence_direction = 'mixed') AS mixed_direction_detected FROM un",
    "dedup_audit": f"SELECT {START} AS start_year, {END} AS end_year, (SELECT count(*) FROM ca) AS classified_rows_before_deduplication, (SELECT count(*) FROM nw) AS unique_news_after_deduplication, (SELECT count(*) FROM ca) - (SELECT count(*) FROM nw) AS duplicates_removed",
    "hard_negative_pool": "SELECT doc_id, _article_key FROM hn",
    "sample_counts": f"SELECT validation_group, {PLACE}, count(*) AS n_sampled FROM (SELECT *, row_number() OVER (PARTITION BY validation_group ORDER BY pos, archive_year NULLS LAST, country NULLS LAST, source NULLS LAST) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY validation_group, {PLACE} ORDER BY doc_id) AS pos FROM po)) WHERE pick <= CASE validation_group " + " ".join(f"WHEN '{g}' THEN {n}" for g, n in sampling.SIZES.items()) + " END GROUP BY ALL",
    "population_weights": f"SELECT validation_group, {PLACE}, n AS sample_stratum_size, total AS population_stratum_size, round(total::DOUBLE / n, 9) AS sample_weight FROM (SELECT validation_group, {PLACE}, count(*) FILTER (WHERE pick <= CASE validation_group " + " ".join(f"WHEN '{g}' THEN {n}" for g, n in sampling.SIZES.items()) + f" END) AS n, count(*) AS total FROM (SELECT *, row_number() OVER (PARTITION BY validation_group ORDER BY pos, archive_year NULLS LAST, country NULLS LAST, source NULLS LAST) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY validation_group, {PLACE} ORDER BY doc_id) AS pos FROM po)) GROUP BY ALL) WHERE n > 0",
    "validation_summary": f"SELECT validation_group, n_reviewed, n_relevant, n_not_relevant, n_uncertain, round(n_relevant::DOUBLE / nullif(n_relevant + n_not_relevant, 0), 9) AS precision_excluding_uncertain, round(good / nullif(whole, 0), 9) AS weighted_precision_excluding_uncertain, round(n_relevant::DOUBLE / n_reviewed, 9) AS conservative_precision, {_low} AS wilson_95_low, {_high} AS wilson_95_high FROM (SELECT validation_group, count(*) AS n_reviewed, count_if(l = 'relevant') AS n_relevant, count_if(l = 'not_relevant') AS n_not_relevant, count_if(l = 'uncertain') AS n_uncertain, coalesce(sum(w) FILTER (WHERE l = 'relevant'), 0) AS good, coalesce(sum(w) FILTER (WHERE l IN ('relevant', 'not_relevant')), 0) AS whole FROM rl WHERE l <> '' GROUP BY 1)",
    "wilson": "SELECT s, n, " + ", ".join(f"{sql} AS {name}" for name, sql in zip(("low", "high"), wilson("s", "n"))) + " FROM (SELECT n, s FROM range(0, 40) a(n), range(0, 40) b(s) WHERE s <= n)",
    "validation_confusion": "SELECT validation_group, count_if(l = 'not_relevant') AS not_relevant, count_if(l = 'relevant') AS relevant, count_if(l = 'uncertain') AS uncertain FROM rl WHERE l <> '' GROUP BY 1",
    "validation_recognition": "SELECT validation_group, count_if(g = 'contextual') AS contextual, count_if(g = 'explicit') AS explicit, count_if(g = 'insufficient') AS insufficient FROM rl WHERE l <> '' AND g <> '' GROUP BY 1",
    "validation_errors": f"SELECT doc_id, lower({strip('manual_case_label')}) AS manual_case_label FROM rv WHERE lower({strip('manual_case_label')}) IN ('not_relevant', 'uncertain')",
    "validation_overall": "SELECT count(*) AS n_rows_in_sample, count_if(l <> '') AS n_reviewed, round(count_if(l <> '')::DOUBLE / count(*), 9) AS completion_rate, round(count_if(validation_group = 'hard_negative' AND l = 'relevant')::DOUBLE / nullif(count_if(validation_group = 'hard_negative' AND l <> ''), 0), 9) AS hard_negative_relevant_rate FROM rl",
    "day_windows": "SELECT strftime(d, '%Y%m%d') AS query_day, s AS source FROM range(TIMESTAMP '2015-12-20', TIMESTAMP '2016-03-06', INTERVAL 1 DAY) r(d), (SELECT DISTINCT source AS s FROM art)",
    "month_windows": "SELECT strftime(d, '%Y_%m') AS run_id, strftime(d, '%Y%m%d') AS from_date, strftime(last_day(d), '%Y%m%d') AS to_date FROM range(TIMESTAMP '2015-03-01', TIMESTAMP '2017-03-01', INTERVAL 1 MONTH) r(d)",
    "cdx_dedup": "SELECT timestamp, original, digest, source, min(event_id) AS event_id FROM cp GROUP BY 1, 2, 3, 4",
    "cdx_summary": "SELECT source, country, year, count(*) AS n_snapshots FROM cp WHERE source IS NOT NULL AND country IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2, 3",
    "homepage_diagnostics": "SELECT source, country, count(timestamp) AS snapshots_seen, count_if(fetch_error IS NOT NULL) AS fetch_errors, count_if(links_extracted > 0) AS snapshots_with_links, sum(links_extracted)::BIGINT AS total_links_extracted, round(avg(links_extracted), 9) AS avg_links_extracted FROM (SELECT *, CASE WHEN statuscode = '404' THEN 'HTTPError' END AS fetch_error, event_id % 7 AS links_extracted FROM cp) WHERE source IS NOT NULL AND country IS NOT NULL GROUP BY 1, 2",
    "article_metrics": "SELECT unnest(['articles_processed', 'fetch_or_parse_errors', 'articles_with_text', 'articles_without_text']) AS metric, unnest([count(*), count_if(fetch_error IS NOT NULL), count_if(length(coalesce(text, '')) > 0), count_if(length(coalesce(text, '')) = 0)]) AS n FROM art",
    "articles_by_source": "SELECT source, country, count(*) AS articles_processed, count_if(length(coalesce(text, '')) > 0) AS articles_with_text, count_if(fetch_error IS NOT NULL) AS fetch_or_parse_errors, round(avg(length(text)), 6) AS avg_text_length FROM art WHERE source IS NOT NULL AND country IS NOT NULL GROUP BY 1, 2",
    "stage_summary": f"SELECT sum(cdx_snapshots)::BIGINT AS cdx_snapshots, sum(homepage_candidates)::BIGINT AS homepage_candidates, sum(clean_candidates)::BIGINT AS clean_candidates, sum(articles_text)::BIGINT AS articles_text, sum(articles_classified)::BIGINT AS articles_classified, count_if(cdx_snapshots > 0 AND source IS NOT NULL) AS sources_with_cdx, count_if(articles_with_text > 0 AND source IS NOT NULL) AS sources_with_text, coalesce(string_agg(source, ',' ORDER BY source) FILTER (WHERE cdx_snapshots > 0 AND homepage_candidates = 0), '') AS missing_homepage_sources, coalesce(string_agg(source, ',' ORDER BY source) FILTER (WHERE homepage_candidates > 0 AND clean_candidates = 0), '') AS missing_clean_sources, coalesce(string_agg(source, ',' ORDER BY source) FILTER (WHERE articles_with_text > 0 AND articles_classified = 0), '') AS missing_classified_sources, round(sum(fetch_or_parse_errors)::DOUBLE / sum(articles_text), 9) AS fetch_error_rate, round(sum(articles_with_text)::DOUBLE / sum(articles_text), 9) AS text_success_rate, 'ok' AS stage_issue FROM (SELECT source, {_counts} FROM ({_stage}) GROUP BY source)",
    "source_issue": f"SELECT e.source, coalesce(cdx_snapshots, 0) AS cdx_snapshots, coalesce(homepage_candidates, 0) AS homepage_candidates, coalesce(clean_candidates, 0) AS clean_candidates, coalesce(articles_text, 0) AS articles_text, coalesce(articles_with_text, 0) AS articles_with_text, coalesce(articles_classified, 0) AS articles_classified, CASE WHEN coalesce(cdx_snapshots, 0) = 0 THEN 'no_cdx' WHEN homepage_candidates = 0 THEN 'cdx_but_no_homepage_candidates' WHEN clean_candidates = 0 THEN 'homepage_but_no_clean_candidates' WHEN articles_text = 0 THEN 'clean_but_no_articles' WHEN articles_with_text = 0 THEN 'articles_without_text' WHEN articles_classified = 0 THEN 'articles_but_no_classified' ELSE 'ok' END AS source_issue FROM (SELECT unnest(['diario_norte', 'diario_sur', 'la_gaceta', 'click', 'view', 'nobody']) AS source) e LEFT JOIN (SELECT source, {_counts} FROM ({_stage}) WHERE source IS NOT NULL GROUP BY source) c ON e.source = c.source",
    "text_excerpt": f"SELECT doc_id, substr({strip(f'regexp_replace(text, {q(W + chr(43))}, {q(chr(32))}, {q(chr(103))})')}, 1, 600) AS text_excerpt FROM cl",
    "retry_merge": "SELECT doc_id, CASE WHEN fetch_error IS NULL THEN NULL WHEN doc_id % 2 = 0 THEN NULL ELSE 'HTTPError: 503' END AS fetch_error, CASE WHEN fetch_error IS NULL THEN md5(coalesce(text, '')) WHEN doc_id % 2 = 0 THEN md5('again ' || doc_id) ELSE md5('') END AS text_md5 FROM art",
}


def oracle_sql() -> dict[str, str]:
    return {name: full(sql) for name, sql in QUERIES.items()}
