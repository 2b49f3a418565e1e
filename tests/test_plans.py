"""Windows, sources, a whole run over captured answers, the stream and the entry module."""

import json
import shutil
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent))

from pressloom.functions.lexicon import Lexicon
from pressloom.operators import articles as A
from pressloom.plans import cli, stages, windows
from pressloom.sources import archive, config, tables
from pressloom.streaming import ingest

# workers cannot import the tests
cloudpickle.register_pickle_by_value(sys.modules[__name__])
LEXICON = Lexicon.default()
CONFIG = {"limit": 3, "sources": [{"name": "press", "domain": "press.com", "country": "AR"}, {"name": "silent", "domain": "silent.com", "country": "MX"}]}
HOME = '<a href="/nota/uno/caso">Una noticia policial larga</a><a href="/nota/dos/caso">Otra noticia larga y mas</a><a href="/tag/x/y">Etiquetas de la nota</a>'
ARTICLES = {"uno": "<h1>Crimen</h1><p>Una mujer fue asesinada por su expareja.</p>", "dos": "<h1>Fiesta</h1><p>El festival del pueblo.</p>"}


class Opener:
    """Answers from memory; the second article fails the first time it is asked for."""

    def __init__(self, failures: str):
        self.failures = failures

    def __call__(self, url: str, timeout: float) -> bytes:
        if url.startswith(archive.SERVICE):
            if "press.com" not in url:
                raise OSError("no such host")
            day = url.split("from=")[1][:8]
            return json.dumps([["timestamp", "original", "statuscode", "mimetype", "digest"], [day + "120000", "http://press.com/", "200", "text/html", "D"], [day + "120000", "http://press.com/", "200", "text/html", "D"]]).encode()
        if "/nota/uno" in url:
            return ARTICLES["uno"].encode()
        if "/nota/dos" in url:
            if not Path(self.failures).exists():
                Path(self.failures).touch()
                raise OSError("timed out")
            return ARTICLES["dos"].encode()
        return HOME.encode()


def test_windows():
    assert [w.run_id for w in windows.windows("yearly", 2015, 2017)] == ["2015", "2016", "2017"]
    months = windows.windows("monthly", 2015, 2016, 11, 2)
    assert [(w.run_id, w.from_date, w.to_date) for w in months] == [("2015_11", "20151101", "20151130"), ("2015_12", "20151201", "20151231"), ("2016_01", "20160101", "20160131"), ("2016_02", "20160201", "20160229")]
    assert windows.label("monthly", 2015, 2016, 11) == "monthly_2015_2016_11_12" and windows.label("yearly", 2015, 2016) == "yearly_2015_2016"
    with pytest.raises(ValueError):
        windows.windows("weekly", 2015, 2016)


def test_day_tables(spark):
    assert [r[0] for r in windows.day_table(spark, "20160228", "20160301").orderBy("query_day").collect()] == ["20160228", "20160229", "20160301"] == archive.days("20160228", "20160301")
    assert windows.month_table(spark, "20160101", "20160201").orderBy("run_id").collect()[1].to_date == "20160229"


def test_run_ids_and_paths():
    assert config.run_id(" ") is None and config.run_id("2015_01.a-b") == "2015_01.a-b"
    with pytest.raises(ValueError):
        config.run_id("../x")
    assert config.RunPaths("r", "a").table("classify") == "r/data/runs/a/processed/articles_classified.parquet" and config.RunPaths("r").base == "r/data"


def test_config(tmp_path, spark):
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs/a.yml").write_text("sources:\n- {name: s, country: AR, domain: d.com}\n- {name: t}\n")
    found = config.load_yaml(config.resolve("a.yml", str(tmp_path)))
    assert [tuple(r) for r in config.expected_sources(spark, found).collect()] == [("s", "AR", "d.com"), ("t", "", "")]
    with pytest.raises(FileNotFoundError):
        config.resolve("b.yml", str(tmp_path))
    log = config.logger("pressloom-test", str(tmp_path / "logs"))
    log.info("hello")
    assert config.logger("pressloom-test", "elsewhere") is log and "hello" in (tmp_path / "logs/pressloom-test.log").read_text()


def test_csv_round_trip(spark, tmp_path):
    rows = [('a "quoted", text\nwith lines', 1, None), ("", 2, ["x"])]
    df = spark.createDataFrame(rows, "t string, n int, a array<string>")
    tables.write_csv(df, f"{tmp_path}/x.csv", bom=True)
    back = tables.csv(spark, f"{tmp_path}/x.csv").orderBy("n").collect()
    assert [(r.t or "", r.n, r.a) for r in back] == [(rows[0][0], "1", None), ("", "2", '["x"]')]


def test_safe_reads_and_replace(spark, tmp_path):
    assert tables.parquet_or_empty(spark, f"{tmp_path}/none", "a int").count() == tables.csv_or_empty(spark, f"{tmp_path}/none", "a int").count() == 0
    (tmp_path / "broken.parquet").write_text("x")
    assert tables.parquet_or_empty(spark, f"{tmp_path}/broken.parquet", "a int").columns == ["a"]
    tables.write(spark.range(3), f"{tmp_path}/t")
    tables.replace(tables.parquet(spark, f"{tmp_path}/t").where("id > 0"), f"{tmp_path}/t")
    assert tables.parquet(spark, f"{tmp_path}/t").count() == 2


def test_index_answers(spark):
    header = list(archive.FIELDS)
    payloads = [json.dumps([header, ["20150101", "u", "200", "m", "d"], ["20160101", "v", "200", "m", "e"]]), json.dumps([header]), "", None, "no json", json.dumps([header[::-1], ["d", "m", "200", "u", "2017"]])]
    df = spark.createDataFrame([(p, "s", "AR", "20150101") for p in payloads], "payload string, source string, country string, query_day string")
    out = sorted((r.timestamp, r.original, r.year) for r in archive.parse_payloads(df).collect())
    assert out == [("20150101", "u", "2015"), ("20160101", "v", "2016"), ("2017", "u", "2017")]
    assert archive.capture_rows(b"") == [] and archive.capture_rows(payloads[0].encode())[1][1] == "v"
    url = archive.query_url("a.com/*", "20150101", "20151231", 5, ["statuscode:200"])
    assert "url=a.com%2F%2A" in url and "output=json" in url and "filter=statuscode%3A200" in url and "limit=5" in url


def test_fetch_takes_what_is_known(spark):
    def opener(url, timeout):
        if "bad" in url:
            raise OSError("no")
        return f"page of {url}".encode()

    asked = spark.createDataFrame([("1", "a"), ("2", "bad"), ("3", "b")], "timestamp string, original string")
    first = archive.fetch_missing(asked, None, "timestamp", "original", opener, 0.0)
    assert {r.original: (r.html, r.fetch_error) for r in first.collect()} == {"a": ("page of https://web.archive.org/web/1id_/a", None), "bad": (None, "OSError: no"), "b": ("page of https://web.archive.org/web/3id_/b", None)}
    known = first.where("original = 'a'").select("html_name", F.lit("kept").alias("html"))
    again = {r.original: r.html for r in archive.fetch_missing(asked, known, "timestamp", "original", opener, 0.0).collect()}
    assert again["a"] == "kept" and again["b"].startswith("page")


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("run"))
    said = []
    for w in windows.windows("yearly", 2015, 2015):
        short = windows.Window(w.run_id, "20150101", "20150102")
        stages.collect(spark, root, [short], CONFIG, LEXICON, Opener(f"{root}/failed"), 0.0, say=said.append)
        stages.collect(spark, root, [short], CONFIG, LEXICON, Opener(f"{root}/failed"), 0.0, say=said.append)
    stages.yearly_tables(spark, root, 2015, 2016)
    stages.contextual_reports(spark, root, LEXICON, 2015, 2016)
    stages.final_corpus(spark, root)
    stages.validation_sample(spark, tables.parquet(spark, f"{root}/outputs/reports/articles_contextual_unique.parquet"), f"{root}/outputs/validation")
    return root, said


def test_collect(spark, run):
    root, said = run
    assert said[:6] == [f"2015 {s}: done" for s in stages.STAGES] and said[6:] == [f"2015 {s}: there already" for s in stages.STAGES]
    out = {r.title: r for r in tables.runs(spark, root).collect()}
    assert out["Crimen"].retrieval_bucket == "not_candidate" and out["Crimen"].run_id == "2015"
    assert out["Fiesta"].fetch_error is None and out["Fiesta"].text == "El festival del pueblo." and len(out) == 2


def test_contextual_outputs(spark, run):
    root, _ = run
    unique = {r.title: r for r in tables.parquet(spark, f"{root}/outputs/reports/articles_contextual_unique.parquet").collect()}
    assert unique["Crimen"].provisional_case_status == "candidate_contextual_high" and unique["Crimen"].snapshot_count == 1
    assert tables.csv(spark, f"{root}/outputs/final/final_case_corpus_summary.csv").first().main_case_articles == "1"
    assert tables.csv(spark, f"{root}/outputs/tables/news_by_year_and_main_category.csv").first().total_unique_news == "2"
    pilot = tables.csv(spark, f"{root}/outputs/validation/contextual_validation_pilot.csv")
    stages.evaluate(spark, pilot.withColumn("manual_case_label", F.lit("relevant")), f"{root}/outputs/validation")
    assert tables.csv(spark, f"{root}/outputs/validation/contextual_validation_overall.csv").first().completion_rate == "1.0"


def test_pipeline_report(spark, run):
    root, _ = run
    text = stages.pipeline_report(spark, root, [windows.Window("2015", "20150101", "20150102"), windows.Window("2016", "20160101", "20160102")], CONFIG, "test")
    assert "windows: 2, ok: 1, to review: 1" in text and "- no_cdx: 1" in text and "source=silent" in text


def test_command_line(spark, run, tmp_path, capsys):
    root, _ = run
    (tmp_path / "c.yml").write_text(json.dumps(CONFIG))
    cli.main(["--root", root, "pipeline", "--mode", "yearly", "--start-year", "2015", "--end-year", "2015", "--config", str(tmp_path / "c.yml"), "--only-summary"], spark)
    assert "windows: 1, ok: 1" in capsys.readouterr().out
    cli.main(["--root", root, "yearly", "--start-year", "2015", "--end-year", "2015"], spark)
    cli.main(["--root", root, "corpus"], spark)


def test_stream(spark, run, tmp_path):
    root, _ = run
    source = tables.parquet(spark, f"{root}/data/runs/2015/extracted_text/articles_text.parquet")
    stream = ingest.classified_stream(spark, f"{root}/data/runs/*/extracted_text/articles_text.parquet", source.schema, LEXICON)
    ingest.append(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    ingest.append(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert tables.parquet(spark, f"{tmp_path}/out").count() == source.count() == 2


def test_stream_merges_and_counts(spark, run, tmp_path):
    root, _ = run
    source = tables.parquet(spark, f"{root}/data/runs/2015/extracted_text/articles_text.parquet")
    stream = ingest.classified_stream(spark, f"{root}/data/runs/*/extracted_text/articles_text.parquet", source.schema, LEXICON)
    once = lambda df: A.first_rows(df, ("normalized_url",), [F.col("snapshot_timestamp")])
    for check in "ab":  # a second stream brings the same rows again
        ingest.merge_unique(stream, f"{tmp_path}/unique", f"{tmp_path}/{check}", once).awaitTermination()
    assert sorted(r.title for r in tables.parquet(spark, f"{tmp_path}/unique").collect()) == ["Crimen", "Fiesta"]
    before = tables.parquet(spark, f"{tmp_path}/unique").inputFiles()
    shutil.rmtree(f"{tmp_path}/b/commits")  # the last batch comes again, as after a failure
    ingest.merge_unique(stream, f"{tmp_path}/unique", f"{tmp_path}/b", once).awaitTermination()
    assert tables.parquet(spark, f"{tmp_path}/unique").inputFiles() == before
    counted = ingest.bucket_counts(stream).writeStream.format("memory").queryName("buckets").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert sum(r.n for r in spark.table("buckets").collect()) == 2


def test_replacement_survives_a_stop(spark, tmp_path):
    path = f"{tmp_path}/t"
    for n in (1, 2):
        tables.replace(spark.range(n), path, f"v{n}")
    assert tables.parquet(spark, path).count() == 2 and tables.marked(spark, path, "v2") and not tables.marked(spark, path, "v1")
    Path(path).rename(f"{path}.old")  # stopped between the two renames
    tables.recover(spark, path)
    assert tables.parquet(spark, path).count() == 2 and not Path(f"{path}.old").exists()
    tables.replace(tables.parquet(spark, path).union(spark.range(1)), path)
    assert tables.parquet(spark, path).count() == 3


def test_entry_without_the_llm_part(monkeypatch):
    import __spark_entry__ as e

    real = e.importlib.import_module
    monkeypatch.setattr(e.importlib, "import_module", lambda name: (_ for _ in ()).throw(ImportError(name)) if name.startswith("pressloom.llm") else real(name))
    assert len(e.queries()) > 60 and not any(n.startswith("op") for n in e.queries()) and "pipeline" not in e.queries()


def test_entry(spark):
    import __spark_entry__ as e

    queries, oracle = e.queries(), e.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 60 and all(map(callable, queries.values()))
