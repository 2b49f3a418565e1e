"""Keys, deduplication, sampling, evaluation and reports on small tables."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pressloom.operators import articles as A
from pressloom.operators import candidates as C
from pressloom.operators import evaluation, reports, sampling

NEWS = "run_id string, source string, country string, snapshot_timestamp string, normalized_url string, retrieval_bucket string, text_length string"


def news(spark, rows):
    df = spark.createDataFrame(rows, NEWS)
    return df.withColumn("archive_year", A.archive_year(df))


def test_archive_year_and_time(spark):
    df = spark.createDataFrame([("20150102030405", "2014_01"), ("x", "2014_01"), (None, None), ("2015", "2014"), ("20151399000000", "a")], "snapshot_timestamp string, run_id string")
    out = df.select(A.archive_year(df).alias("y"), A.snapshot_datetime(F.col("snapshot_timestamp")).cast("string").alias("t")).collect()
    assert [tuple(r) for r in out] == [(2015, "2015-01-02 03:04:05"), (2014, None), (None, None), (2015, None), (2015, None)]


def test_keys(spark):
    df = spark.createDataFrame([(" AR ", "s", " u ", "r", 1), (None, None, "", "r", 2)], "country string, source string, normalized_url string, run_id string, n int")
    assert [r[0] for r in A.with_article_key(df, "n").select("_article_key").collect()] == ["AR|s|u", "r|row|2"]


def test_dedup_news_keeps_the_strongest_then_the_longest(spark):
    rows = [("2015_01", "s", "AR", "20150101", "u", "not_candidate", "900"), ("2015_02", "s", "AR", "20150201", "u", "case_review_x", "10"), ("2015_03", "s", "AR", "20150301", "u", "case_review_x", "20"), ("2015_04", "s", "AR", "20150401", "u", None, "bad"), ("2016_01", "s", "AR", "20160101", "u", "topic_x", None), ("2015_05", None, None, None, None, "case_strong", "1"), ("2015_06", None, None, None, None, "case_strong", "1")]
    out = A.deduplicate_news(A.with_article_key(news(spark, rows), "run_id")).collect()
    assert sorted((r.archive_year, r.run_id, r.main_category) for r in out) == [(2015, "2015_03", "case_review"), (2015, "2015_05", "case_strong"), (2015, "2015_06", "case_strong"), (2016, "2016_01", "topic")]


def test_dedup_ties_fall_to_the_earliest(spark):
    rows = [(f"2015_0{k}", "s", "AR", f"2015010{k}", "u", "case_strong", "5") for k in (3, 1, 2)]
    assert [r.run_id for r in A.deduplicate_news(A.with_article_key(news(spark, rows))).collect()] == ["2015_01"]


def test_dedup_articles_and_statistics(spark):
    rows = [(2015, "k", "not_selected", 3, 10, "2015-01-01"), (2015, "k", "review_contextual_medium", 2, 10, "2015-02-01"), (2015, "k", "review_contextual_medium", 2, 30, "2015-03-01"), (None, "k", "odd", None, None, None)]
    df = spark.createDataFrame(rows, "archive_year int, _article_key string, provisional_case_status string, contextual_score int, text_length int, t string").withColumn("snapshot_datetime", F.col("t").cast("timestamp_ntz"))
    out = {r.archive_year: r for r in A.deduplicate_articles(df).collect()}
    assert (out[2015].t, out[2015].snapshot_count, str(out[2015].first_snapshot_datetime)[:10], str(out[2015].last_snapshot_datetime)[:10]) == ("2015-03-01", 3, "2015-01-01", "2015-03-01")
    assert out[None]._status_rank == -1 and out[None].text_length == 0


def test_dedup_combines_before_the_shuffle(spark):
    df = spark.range(10_000).select(F.lit("hot").alias("k"), "id", F.col("id").cast("string").alias("text"))
    plan = A.first_rows(df, ("k",), [F.col("id")])._jdf.queryExecution().toString()
    assert "partial_min_by" in plan and A.first_rows(df, ("k",), [F.col("id")]).collect() == [Row(k="hot", id=0, text="0")]


def population(spark):
    rows = [(i, s, y, c, "not_candidate" if s == "not_selected" else "case_x", t) for i, (s, y, c, t) in enumerate(
        [("candidate_explicit_case", 2015, "AR", "x")] * 7 + [("candidate_explicit_case", 2016, None, "x")] * 2 + [("review_ambiguous_case", None, "MX", "x")] * 3 + [("not_selected", 2015, "AR", "Una mujer")] * 4 + [("not_selected", 2015, "AR", "nada")] * 9
    )]
    return spark.createDataFrame(rows, "id int, provisional_case_status string, archive_year int, country string, retrieval_bucket string, title string")


def test_round_robin_balances(spark):
    sizes = {"explicit_case_control": 5, "ambiguous_case": 10, "hard_negative": 3}
    out = sampling.pilot(population(spark), sizes, key=["id"]).collect()
    count = lambda g, y: sum(r.validation_group == g and r.archive_year == y for r in out)
    assert (count("explicit_case_control", 2015), count("explicit_case_control", 2016), count("ambiguous_case", None), count("hard_negative", 2015)) == (3, 2, 3, 3)
    assert {(r.validation_group, r.archive_year): (r.population_stratum_size, r.sample_stratum_size, r.sample_weight) for r in out} == {("explicit_case_control", 2015): (7, 3, 7 / 3), ("explicit_case_control", 2016): (2, 2, 1.0), ("ambiguous_case", None): (3, 3, 1.0), ("hard_negative", 2015): (4, 3, 4 / 3)}
    assert out[0].manual_case_label == "" and {r.id for r in out} == {r.id for r in sampling.pilot(population(spark), sizes, key=["id"]).collect()}
    assert {r.id for r in sampling.draw(population(spark), sizes, 43, ["id"]).collect()} != {r.id for r in out}


def test_weights_add_up_to_the_population(spark):
    sums = sampling.pilot(population(spark), {"explicit_case_control": 4}, key=["id"]).groupBy("archive_year").agg(F.sum("sample_weight").alias("w"), F.max("population_stratum_size").alias("n")).collect()
    assert all(math.isclose(r.w, r.n) for r in sums) and len(sums) == 2


def test_hard_negatives_fall_back(spark):
    assert sampling.hard_negatives(population(spark)).count() == 4
    assert sampling.hard_negatives(population(spark).where("title <> 'Una mujer'")).count() == 9
    assert sampling.hard_negatives(population(spark).where("id < 0")).count() == 0


def wilson(s, n, z=1.96):
    p, d = s / n, 1 + z * z / n
    c, m = (p + z * z / (2 * n)) / d, z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n) / d
    return max(0.0, c - m), min(1.0, c + m)


def test_wilson(spark):
    df = spark.createDataFrame([(s, n) for n in range(0, 12) for s in range(n + 1)], "s int, n int")
    for r in df.select("s", "n", *[c.alias(k) for c, k in zip(evaluation.wilson(F.col("s"), F.col("n")), ("a", "b"))]).collect():
        assert (r.a, r.b) == ((None, None) if r.n == 0 else pytest.approx(wilson(r.s, r.n)))


def test_evaluation(spark):
    rows = [("a", " Relevant", "explicit", "2"), ("a", "not_relevant", None, "x"), ("a", "UNCERTAIN", "", "5"), ("hard_negative", "relevant", "contextual", "1"), ("hard_negative", "", "", "1"), ("b", "uncertain", "", "1")]
    df = spark.createDataFrame(rows, "validation_group string, manual_case_label string, manual_gender_recognition string, sample_weight string")
    labelled = evaluation.reviewed(df)
    out = {r.validation_group: r for r in evaluation.summarize(labelled).collect()}
    assert tuple(out["a"])[1:8] == (3, 1, 1, 1, 0.5, pytest.approx(2 / 3), pytest.approx(1 / 3))
    assert out["b"].precision_excluding_uncertain is None and out["b"].wilson_95_low is None and out["b"].weighted_precision_excluding_uncertain is None
    assert tuple(evaluation.overall(df).first()) == (6, 5, pytest.approx(5 / 6), 1.0)
    assert {tuple(r) for r in evaluation.confusion(labelled).collect()} == {("a", 1, 1, 1), ("hard_negative", 0, 1, 0), ("b", 0, 0, 1)}
    assert evaluation.errors(labelled).count() == 3 and evaluation.recognition(labelled).count() == 2
    for bad, error in ((df.drop("validation_group"), KeyError), (df.withColumn("manual_case_label", F.lit("maybe")), ValueError), (df.withColumn("manual_case_label", F.lit("")), ValueError), (df.withColumn("manual_gender_recognition", F.lit("x")), ValueError)):
        with pytest.raises(error):
            evaluation.reviewed(bad)


def test_null_keys_are_dropped_or_kept(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), (None, "x")], "source string, country string")
    assert reports.counts(df, ("source", "country")).count() == 3 and reports.counts(df, ("source", "country"), nulls=False).count() == 1


def test_categories_and_coverage(spark):
    rows = [("r", "s", "AR", "2015", f"u{k}", b, "1") for k, b in enumerate(["case_strong", "case_review_x", "topic_y", "not_candidate", None, "case_strong"])]
    unique = A.deduplicate_news(A.with_article_key(news(spark, rows)))
    assert tuple(reports.categories_by_year(unique).first()) == (2015, 2, 1, 3, 1, 1, 1, 6)
    assert tuple(reports.coverage(unique).first()) == (2015, "AR", "s", 6, 2, 1, 1, 0.5)
    assert tuple(reports.dedup_audit(news(spark, rows), unique, 2015, 2016).first()) == (2015, 2016, 6, 6, 0)
    assert sorted(reports.wide(unique, "archive_year", "retrieval_bucket").columns) == ["archive_year", "case_review_x", "case_strong", "not_candidate", "topic_y", "unknown"]


STAGE = "source string, text string, fetch_error string, retrieval_bucket string"


def test_stage_ladders(spark):
    table = lambda *rows: spark.createDataFrame([(s, t, e, b) for s, t, e, b in rows], STAGE)
    row = lambda s, t=None, e=None, b=None: (s, t, e, b)
    full = {"cdx_snapshots": table(row("a"), row("b"), row("c"), row(None)), "homepage_candidates": table(row("a"), row("b")), "clean_candidates": table(row("a"), row("b")), "articles_text": table(row("a", "t"), row("b", "", "E")), "articles_classified": table(row("a", b="case_strong"))}
    one = reports.window_summary(full, "r", "f", "t").first()
    assert (one.cdx_snapshots, one.sources_with_cdx, one.missing_homepage_sources, one.missing_text_sources, one.fetch_error_rate, one.text_success_rate, one.case_strong, one.stage_issue) == (4, 3, "c", "b", 0.5, 0.5, 1, "ok")
    for k, (stage, issue) in enumerate(reports.WINDOW_LADDER):
        part = {s: (full[s] if i < k else table()) for i, s in enumerate(reports.STAGES)}
        assert reports.window_summary(part, "r", "f", "t").first().stage_issue == issue, stage
    expected = spark.createDataFrame([(s, "AR", "d") for s in "abcd"], "source string, country string, domain string")
    assert {r.source: r.source_issue for r in reports.source_stages(expected, full, "r", "f", "t").collect()} == {"a": "ok", "b": "articles_without_text", "c": "cdx_but_no_homepage_candidates", "d": "no_cdx"}
    assert {k: v.count() for k, v in reports.problem_windows(reports.window_summary(full, "r", "f", "t")).items()} == {"stage": 0, "missing_homepage": 1, "fetch_errors": 1, "little_text": 1, "classification": 1}


PAGE = """<html><head><title>T</title></head><body><nav><a href="/nav">N</a></nav>
<a href="/web/20150101000000/http://www.press.com/nota/uno/dos">Una <b>nota</b> larga</a> <a href="nota/tres">Otra nota larga</a>
<a href="http://other.com/x/y">Fuera</a> <a href="//press.com/a/b/c">Sin esquema</a> <a>nada</a> <a href="mailto:x@y.z">m</a>
<h1>El <i>título</i></h1><script>var x = "</p>";</script><p>Un párrafo.</p><p>Otro.</p></body></html>"""


def test_links(spark):
    pages = spark.createDataFrame([("s", "AR", "20150101", "http://press.com/", PAGE, None), ("s", "AR", "20150102", "http://press.com/", PAGE, None), ("s", "AR", "20150103", "http://press.com/", None, "E")], "source string, country string, timestamp string, original string, html string, fetch_error string")
    found = C.links(pages)
    assert sorted(r.candidate_url for r in found.where("snapshot_timestamp = '20150101'").collect()) == ["http://press.com/a/b/c", "http://press.com/nav", "http://press.com/nota/tres", "http://www.press.com/nota/uno/dos"]
    kept = C.homepage_candidates(found)
    assert kept.count() == 4 and {r.snapshot_timestamp for r in kept.collect()} == {"20150101"}
    assert {r.anchor_text for r in kept.collect()} >= {"Una nota larga", "Otra nota larga"}
    assert [(r.links_extracted, r.fetch_error) for r in C.diagnostics(pages).orderBy("timestamp").collect()] == [(4, None), (4, None), (0, "E")]
    assert [r.normalized_url for r in C.clean_candidates(kept).orderBy("normalized_url").collect()] == ["http://press.com/a/b/c", "http://press.com/nota/tres", "http://press.com/nota/uno/dos"]


def test_article_parse(spark):
    df = spark.createDataFrame([(1, PAGE, None), (2, None, None), (3, "<article>Uno <p>dos</p></article>", None), (4, PAGE, "E")], "i int, html string, fetch_error string")
    assert [tuple(r) for r in C.parsed(df).orderBy("i").select("title", "text", "text_length").collect()] == [("El título", "Un párrafo.\nOtro.", 17), ("", "", 0), ("", "Uno\ndos", 7), ("", "", 0)]


def test_empty_tables(spark):
    empty = news(spark, [])
    unique = A.deduplicate_news(A.with_article_key(empty))
    assert unique.count() == reports.coverage(unique).count() == reports.categories_by_year(unique).count() == 0
    assert reports.article_metrics(spark.createDataFrame([], "text string, fetch_error string")).count() == 4
