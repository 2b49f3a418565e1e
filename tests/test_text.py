"""Text, URL and lexicon functions against plain Python."""

import re
import unicodedata
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressloom import queries
from pressloom.functions import patterns as P
from pressloom.functions import text as X
from pressloom.functions import urls as U
from pressloom.functions.lexicon import Lexicon, deep_merge, flatten, plain
from pressloom.operators import matching as M


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.repartition(1).sortWithinPartitions("i").select(make(F.col("v"))).collect()]


def normalized(text):
    base = "".join(c for c in unicodedata.normalize("NFD", text or "") if unicodedata.category(c) != "Mn").lower()
    return re.sub(r"\s+", " ", base).strip()


TEXTS = ["", None, "  Ñandú\t\n ÁÉÍ ", "violó a la niña", "İstanbul", "a b c", "é \x1c x", "łmujer", "ﬁn œuvre ß"]


def test_normalize(spark):
    assert column(spark, TEXTS, X.normalize) == [normalized(t) for t in TEXTS]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", min_codepoint=1, max_codepoint=0x24F), max_size=30), min_size=20, max_size=40))
def test_normalize_random(spark, texts):
    assert column(spark, texts, X.normalize) == [normalized(t) for t in texts]


def windows(text):
    found = [s for p in re.split(r"(?<=[.?!])\s+|\n+", text or "") if (s := p.strip())]
    return [w for i, s in enumerate(found) for w in ([s, f"{s} {found[i + 1]}"] if i + 1 < len(found) else [s])]


def test_sentence_windows(spark):
    texts = ["", None, "Uno. Dos? Tres!\n\nCuatro", "sin punto", "a.b. c", "...\n\n \n x", "¿Qué?  Sí."]
    assert column(spark, texts, lambda c: X.let(X.sentences(c), X.sentence_windows)) == [windows(t) for t in texts]


def test_mojibake(spark):
    def repaired(t):
        if not t or "Ã" not in t:
            return t or ""
        fixed = t.encode("latin-1", "ignore").decode("utf-8", "ignore")
        return fixed if fixed.count("Ã") < t.count("Ã") else t

    texts = ["El niÃ±o", "Â sola", "Ã", "bien", None, "maÃ±ana → €", "aÃ"]
    assert column(spark, texts, X.repair_mojibake) == [repaired(t) for t in texts]


def test_clean_text(spark):
    rows = [("eluniversal_mx", "-\nFlipear\nRevista\nUna noticia.\n\n\n\nOtra"), ("x", "Flipear\nUna\nSíguenos en redes\n  dos   tres "), ("x", None), (None, "a\r\nb c")]
    df = spark.createDataFrame(rows, "s string, t string").repartition(1)
    assert [r[0] for r in df.select(X.clean_text(F.col("t"), F.col("s"))).collect()] == ["Una noticia.\nOtra", "Flipear\nUna\ndos tres", "", "a\nb\nc"]


def test_excerpt_and_first_nonblank(spark):
    df = spark.createDataFrame([(" a \n b ", None, " z ")], "a string, b string, c string")
    assert df.select(X.excerpt(F.col("a"), 2), X.first_nonblank(F.col("b"), F.col("c"))).first() == ("a ", "z")


@pytest.mark.parametrize(
    ("url", "anchor", "no_article", "article"),
    [
        ("http://a.com/nota/uno/dos", "Una nota de diez", False, True), ("http://a.com/nota/uno/dos", " corta ", False, False), ("http://a.com/nota/uno/dos", None, False, False), (None, "Una nota de diez", True, False),
        ("http://a.com/", "Una nota de diez", True, False), ("http://a.com/tag/uno/dos", "Una nota de diez", True, False), ("http://a.com/x/y/z.PDF", "Una nota de diez", True, False),
        ("http://a.com/nota/uno#x", "Una nota de diez", True, False), ("http://a.com/uno", "Una nota de diez", False, False), ("http://a.com/index.html", "Una nota de diez", True, False),
    ],
)
def test_article_urls(spark, url, anchor, no_article, article):
    df = spark.createDataFrame([(url, anchor)], "u string, a string")
    assert df.select(U.is_no_article(F.col("u")), U.looks_like_article(F.col("u"), F.col("a"))).first() == (no_article, article)


def test_normalize_url(spark):
    urls = ["HTTPS://WWW.Example.com:443/Nota/a//?q=1#x", "http://user@www.a.com", "/solo/ruta/", "", None, "http://a.com/x;p=1"]
    assert column(spark, urls, U.normalize_url) == ["http://example.com/Nota/a", "http://a.com", "http:///solo/ruta", "http://", "http://", "http://a.com/x"]


def test_wayback(spark):
    df = spark.createDataFrame([("/web/20150101/http://a.com/x", "http://www.a.com/y", "http://a.com"), ("/web/", "ftp://a.com", "http://a.com")], "h string, u string, b string")
    out = df.select(U.unwrap_wayback(F.col("h")), U.is_internal(F.col("u"), F.col("b")), U.wayback_raw_url(F.lit("2015"), F.col("b"))).collect()
    assert [tuple(r) for r in out] == [("http://a.com/x", True, "https://web.archive.org/web/2015id_/http://a.com"), ("/web/", False, "https://web.archive.org/web/2015id_/http://a.com")]


def test_lexicon():
    tree = {"direct_terms": {"high_precision": ["Femicidio", "femicidio", " "]}, "other": {"x": ["y"]}, "thresholds": {"strong_candidate": 9}, "aggressor_terms": {"a": {"b": ["uno"]}}}
    assert flatten(tree) == {"direct_terms.high_precision": ["Femicidio"], "aggressor_terms.a.b": ["uno"]}
    lex = Lexicon.from_tree(tree, {"aggressor_terms": {"a": {"c": ["dos"]}}})
    assert lex.under("aggressor_terms.a") == ["aggressor_terms.a.b", "aggressor_terms.a.c"] and lex.thresholds["strong_candidate"] == 9
    assert deep_merge({"a": {"b": 1}}, {"a": {"c": 2}, "d": 3}) == {"a": {"b": 1, "c": 2}, "d": 3} and deep_merge({"a": 1}, {"a": {"b": 2}}) == {"a": {"b": 2}}


def test_default_lexicon_has_every_root_in_use():
    lex = Lexicon.default()
    assert len(lex.groups) == 24 and sum(map(len, lex.groups.values())) < 200


def test_term_borders(spark):
    lex = Lexicon({"g.a": ("ex pareja", "mató"), "g.b": ("ex-pareja",)}, {})
    texts = ["la ex   pareja", "łmató", "la mató.", "ex-pareja", "expareja", "matón", ""]
    out = column(spark, texts, lambda c: M.groups_in(X.normalize(c), lex))
    assert out == [["g.a"], [], ["g.a"], ["g.b"], [], [], []]
    terms = column(spark, texts, lambda c: M.terms_in(X.normalize(c), lex))
    assert terms[2] == {"g.a": ["mató"]} and terms[5] == {}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("abñ -.,_1é"), max_size=20), min_size=30, max_size=50))
def test_matching_random(spark, texts):
    lex = Lexicon({"g": ("ab", "a b", "ñ-a")}, {})
    expected = [[t for t in sorted(lex.groups["g"]) if re.search(r"(?<!\w)" + re.escape(plain(t)).replace(r"\ ", r"\s+") + r"(?!\w)", normalized(x))] for x in texts]
    assert column(spark, texts, lambda c: F.coalesce(F.element_at(M.terms_in(X.normalize(c), lex), F.lit("g")), F.array().cast("array<string>"))) == expected


def test_needed_strings_are_in_every_match():
    lit = lambda w: re.sub(r"\w\?", "", re.sub(r"\[(\w)\w*\]", r"\1", w)).replace("_", " ")
    for finding, phrases in P.PHRASES.items():
        for phrase in phrases:
            items = [re.sub(r"\{(\w+)\}", lambda m: P.WORDS[m[1]].replace(" ", "|"), i).split("|") for i in phrase.split() if i[0] not in "?~<"]
            for k, item in enumerate(items):
                for w in item:
                    text = " ".join(lit(w if j == k else other[-1]) for j, other in enumerate(items))
                    assert re.search(P.tight(finding).removeprefix("(?U)"), text) and any(x in text for x in P.needed(finding)), (finding, text)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_findings_and_windows_random(spark, data):
    """The expressions with their borders taken out find what the plain ones do, and windows are those of the plain text."""
    words = sorted({w.replace("n?", "n").replace("_", " ") for ws in P.WORDS.values() for w in ws.split()} | {"la", "una", "un", "a", "su", "de", "fue", "lo", "murió", "muertas", "signos", "casa", "x", "asesinado"})
    ends = [" ", " ", " ", ". ", "\n", ", ", " \u0301 ", "-"]
    texts = data.draw(st.lists(st.lists(st.tuples(st.sampled_from(words), st.sampled_from(ends)), max_size=12).map(lambda ps: "".join(map("".join, ps))), min_size=40, max_size=60))
    for finding in ("woman attacked", "man as victim", "violent event", "clearly her against him"):
        assert column(spark, texts, lambda c, f=finding: M.shows(X.normalize(c), f)) == column(spark, texts, lambda c, f=finding: X.normalize(c).rlike(P.any_of(f)))
    lex = Lexicon({"g.a": ("mujer", "la mujer", "murió"), "g.b": ("la mujer", "asesino-a", "padre")}, {})
    found = column(spark, texts, lambda c: M.matched_text(c, lex))
    for text, row in zip(texts, found):
        hits = lambda t: [(g, x) for g, ts in lex.groups.items() for x in sorted(ts) if re.search(rf"(?<!\w){re.escape(plain(x))}(?!\w)", normalized(t))]
        assert row["groups"] == sorted({g for g, _ in hits(text)})
        expected = [(k, w, sorted({f" {plain(x)} " for _, x in hits(w)}), normalized(w)) for k, w in enumerate(windows(text)) if hits(w)]
        assert [(w["window_id"], w["window_text"], sorted(w["terms"]), w["head"]) for w in row["windows"]] == expected


@pytest.mark.parametrize("name", ["matched_terms", "proximity_evidence", "contextual_evidence", "male_victim_flag", "lexicon_match_window", "violence_direction", "sentence_windows"])
def test_sentences_are_made_once(spark, name):
    """No filter on what is made of the sentences, given or inferred, is put below it with all of it once more."""
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no tables")
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=[.?!]") == 1


def test_one_row_group_is_many_tasks(spark, tmp_path):
    """A file of one row group, which a single task reads, is classified by many."""
    rows = [(k, "La mujer fue asesinada.", "es", "web") for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for make in (queries.cleaned, queries.classified, queries.snapshots, queries.shown):
            assert make(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
