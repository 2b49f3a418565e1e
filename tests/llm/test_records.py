"""URL filter, web archive records and the pipeline."""

import gzip
import html
import importlib.util
import random
import re
import time
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from pressloom.llm import common, queries, urlfilter, warc


# ---- url filter ---------------------------------------------------------------

URLS = [
    "http://example.com/en/1", "http://www.example.com/en/1", "http://m.www.example.com/en/x", "https://a.net/es/2", "https://a.net/de/2", "HTTP://A.NET/ES/2", "https://NET/fr/9?x#y", "http://other.org/en/1",
    "no scheme", None, "", "http://", "http://host", "http://host?q=/x", "x://y://z/a", "http://example.com/en", "http://notexample.com/en/1", "http://example.com.evil.org/en/1", "http://anet/es/1", "http://é.net/es/",
]


def plain_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    best = max((r for r in urlfilter.RULES if (host == (h := r[1].split("/")[0]) or host.endswith("." + h)) and path.startswith(r[1][len(h) :])), key=lambda r: len(r[1]), default=None)
    return host, path, best and best[1], best and best[0]


def judged(spark, urls, bad=()):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame(list(bad), "key long, bad boolean")
    return {r.page_id: r for r in urlfilter.judge(pages, labels, urlfilter.page_key(F.col("url"))).collect()}


def test_rules(spark):
    out = judged(spark, URLS)
    for k, url in enumerate(URLS):
        host, path, rule, verdict = plain_rule(url)
        r = out[k]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or "allow"), url


def test_bad_templates_are_rejected(spark):
    urls = [f"http://farm.org/spam/{k}" for k in range(30)] + [f"http://farm.org/news/{k}" for k in range(100, 130)] + [f"http://few.org/p/{k}" for k in (200, 201)] + [f"http://good.org/p/{k}" for k in range(300, 400)]
    labels = [(k, True) for k in range(25)] + [(k, False) for k in [*range(100, 130), *range(300, 400)]] + [(200, True), (201, True)]
    out = judged(spark, urls, labels)
    assert {out[k].verdict for k in range(30)} == {"block"} and {out[k].verdict for k in range(30, 60)} == {"allow"}
    assert {out[k].verdict for k in (60, 61)} == {"allow"}, "two labels do not outweigh the prior"


def test_variable_segments_become_wildcards(spark):
    seen = spark.createDataFrame([("h", f"/a/name{k}/x", 1, 0, 0) for k in range(40)] + [("h", "/b/c", 9, 0, 0)], "host string, shape string, n long, labelled long, bad long")
    assert {r.template for r in urlfilter.templates(seen).collect()} == {"/a/*/x", "/b/c"}


def test_no_branch_is_too_deep(spark):
    """Branches that part at any depth have verdicts of their own."""
    for depth in (3, 9, 11, 12, 13, 40):
        way = "/".join(f"s{chr(97 + k % 26)}" for k in range(depth))
        urls = [f"http://deep.org/{way}/spam/{k}" for k in range(40)] + [f"http://deep.org/{way}/good/{k}" for k in range(100, 140)]
        out = judged(spark, urls, [(k, True) for k in range(40)] + [(k, False) for k in range(100, 140)])
        assert {out[k].verdict for k in range(40)} == {"block"} and {out[k].verdict for k in range(40, 80)} == {"allow"}, depth


def test_url_filter_of_nothing_and_clashes(spark):
    assert judged(spark, []) == {}
    pages = spark.createDataFrame([(None, "http://a.org/1", "x", 1), (None, "http://a.org/1", "x", 1)], "page_id long, url string, host string, key int")
    labels = spark.createDataFrame([(1, True), (1, None), (None, True)], "key long, bad boolean")
    assert [tuple(r) for r in urlfilter.judge(pages, labels, urlfilter.page_key(F.col("url"))).collect()] == [(None, "a.org", "/1", None, "block")] * 2


def test_url_filter_is_native_and_matches_sql(spark):
    deep = [(1000 + k, "http://d.org/" + "/".join("abcdefghijklmnopqrst"[: k % 17]) + f"/{k}") for k in range(60)]
    pages = spark.createDataFrame(deep + [(k, f"http://{random.Random(k).choice(['a.org', 'b.example.com', 'c.net'])}/{random.Random(k).choice(['en', 'es', 'x'])}/{k}") for k in range(300)], "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 3 // 2, k % 7 // 6) for k in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    rows = labels.select(F.col("doc_id").alias("key"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    df = urlfilter.judge(pages, rows, urlfilter.page_key(F.col("url")))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    con.register("labels", labels.toPandas())
    assert sorted(map(tuple, df.select("page_id", "host", "path", "rule", "verdict").collect())) == sorted(con.sql(urlfilter.oracle()).fetchall())


# ---- web archive ----------------------------------------------------------------

HTML = '<html lang="fr"><head><title>Le &amp; titre</title><style>p{}</style></head><body><script>var t="</p>";</script><p>Un  texte</p><p>deux<br>lignes</p><a href="/x?a=1&amp;b=2">lien</a><!-- no --></body></html>'


def test_derivatives_are_linked(spark):
    pages = spark.createDataFrame([(1, "http://a/b", HTML), (2, None, None), (1, "http://a/b", HTML)], "page_id long, url string, html string")
    responses = warc.responses(pages)
    source = {r.page_id: r for r in responses.collect()}
    out = warc.derivatives(responses).collect()
    assert len(out) == 6 and {r.record_type for r in out} == {"metadata", "conversion"}
    by = {(r.page_id, r.record_type): r for r in out}
    for r in out:
        assert r.refers_to == source[r.page_id].record_id and r.payload_digest == warc.digest((HTML if r.page_id == 1 else "").encode())
    text = by[1, "conversion"].record.split("\r\n\r\n", 1)[1]
    assert text == "Un texte\ndeux\nlignes\nlien" and by[1, "conversion"].block_digest == warc.digest(text.encode()) and by[1, "conversion"].content_length == len(text.encode())
    fields = by[1, "metadata"].record
    assert "title: Le & titre\r\n" in fields and "language: fr\r\n" in fields and "outlink: /x?a=1&b=2\r\n" in fields and "source-header: Content-Type: text/html; charset=utf-8\r\n" in fields
    assert by[2, "conversion"].content_length == 0 and by[2, "conversion"].target_uri == ""
    assert len({r.record_id for r in out}) == 4, "equal rows have equal names"
    assert warc.derivatives(responses.limit(0)).count() == 0 and warc.derivatives(responses.withColumn("record_type", F.lit("request"))).count() == 0


class Plain(HTMLParser):
    """Visible text and links by the standard library's parser."""

    def __init__(self, markup):
        super().__init__(convert_charrefs=False)
        self.parts, self.links, self.off = [], [], 0
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.off += tag in warc.DROPPED or tag == "head"
        if tag in warc.BREAKING and not self.off:
            self.parts.append("\0")
        if tag == "a" and dict(attrs).get("href"):
            self.links.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        self.off -= tag in warc.DROPPED or tag == "head"
        if tag in warc.BREAKING and not self.off:
            self.parts.append("\0")

    def handle_data(self, data):
        if not self.off:
            self.parts.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")

    def text(self):
        lines = html.unescape("".join(self.parts).replace("\n", " ").replace("\r", " ").replace("\0", "\n")).split("\n")
        return [x for line in lines if (x := " ".join(line.split()))]


def test_pages_against_the_standard_parser(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    for markup in [HTML, *(r.html for r in pages)]:
        page, other = warc.Page(markup or ""), Plain(markup or "")
        assert [" ".join(x.split()) for x in page.text.split("\n") if x] == other.text() and page.links == other.links


@pytest.mark.parametrize("bit", ["<a ", "<title>", "<!--", '<a href="', "<script>", "</script", "<a '\"", "<a b='", "&#", "<", "<p", "<html lang=", "<a href=x ", "<meta charset"])
def test_hostile_pages_cost_linear_time(bit):
    for end in ("", ">"):
        began = time.perf_counter()
        warc.derived_from({"block": (bit * 200_000 + end).encode(), "payload_digest": None, "block_digest": None, "record_id": "r", "target_uri": "", "warc_date": "", "page_id": 1, "headers": None})
        assert time.perf_counter() - began < 20


def test_quoted_ends_unclosed_and_empty_pages():
    page = warc.Page('<TITLE>a<b</TITLE><p title="x>y">one<br/>two</p><a href=\'u>v\'>t</a><a name=q href=plain>s</a><script>if (a<b) {}</script >end<style>')
    assert (page.title, page.text, page.links) == ("a<b", "a<b\none\ntwo\ntsend", ["u>v", "plain"])
    assert warc.Page("").text == "" and warc.Page("1 < 2 and <3").text == "1 < 2 and <3"


def test_records_with_odd_headers(spark, tmp_path):
    gz = gzip.compress(b"<html lang=de><p>gepackt</p>")
    chunked = b"5\r\n<p>ab\r\n3;x=y\r\ncd<\r\n0\r\n\r\n"
    inner = b"HTTP/1.1 200 OK\r\ncontent-type: text/html\r\n\r\n<p>WARC/1.1\r\nnot a record\r\n\r\nWARC/1.0\r\n</p>"
    bodies = [b"HTTP/1.1 200 OK\r\ncontent-ENCODING: gzip\r\nSet-Cookie: a\r\nSet-Cookie: b\r\n\r\n" + gz, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked, inner]
    whole = [f"WARC/1.{k % 2}\r\nwarc-TYPE: response\r\nWARC-Record-Id: <urn:uuid:{k}>\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nX-Long: one\r\n  two\r\ncontent-length: {len(b)}\r\n\r\n".encode() + b for k, b in enumerate(bodies)]
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(w + warc.END for w in whole)))  # one member for all
    (tmp_path / "plain.warc").write_bytes(b"".join(w + warc.END for w in whole))
    for name in ("one.warc.gz", "plain.warc"):
        found = warc.read_warc(spark, f"{tmp_path}/{name}")
        rows = {r.record_id: r for r in found.collect()}
        assert [bytes(rows[f"<urn:uuid:{k}>"].block) for k in range(3)] == bodies and len(rows) == 3
        assert [h for h in rows["<urn:uuid:0>"].headers if "Concurrent" in h] == ["WARC-Concurrent-To: <a>", "WARC-Concurrent-To: <b>"] and "X-Long: one two" in rows["<urn:uuid:0>"].headers
        out = {(r.refers_to, r.record_type): r.record for r in warc.derivatives(found).collect()}
        text = lambda k: out[f"<urn:uuid:{k}>", "conversion"].split("\r\n\r\n", 1)[1]
        assert (text(0), text(1)) == ("gepackt", "abcd<") and text(2).startswith("WARC/1.1") and out["<urn:uuid:0>", "metadata"].count("source-header: Set-Cookie") == 2


def test_clashing_columns_of_pages(spark):
    pages = spark.createDataFrame([(None, None, None, "x", 1)], "page_id long, url string, html string, block string, record_id int")
    assert [(r.page_id, r.record_type) for r in warc.derivatives(warc.responses(pages)).collect()] == [(None, "metadata"), (None, "conversion")]


def test_records_survive_files(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://a/{k}", HTML if k % 2 else "é" * k) for k in range(6)], "page_id long, url string, html string")
    derived = warc.derivatives(warc.responses(pages))
    warc.write_warc(derived, f"{tmp_path}/w")
    files = list(Path(tmp_path, "w").glob("part-*"))
    assert files and all(f.read_bytes()[:2] == b"\x1f\x8b" for f in files)
    back = {r.record_id: r for r in warc.read_warc(spark, f"{tmp_path}/w/part-*").collect()}
    for r in derived.collect():
        b = back[r.record_id]
        assert (b.record_type, b.refers_to, b.target_uri, b.content_length) == (r.record_type, r.refers_to, r.target_uri, r.content_length) and warc.digest(bytes(b.block)) == r.block_digest == b.block_digest


def test_foreign_responses(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nX-A: 1\r\n\r\n<p>\xe9t\xe9</p>"
    records = [warc.record_bytes("response", {"WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://x", "WARC-Date": "2020-01-01T00:00:00Z", "WARC-Payload-Digest": "sha1:GIVEN"}, body), warc.record_bytes("request", {"WARC-Record-ID": "<urn:uuid:2>"}, b"GET /")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r + warc.END) for r in records))
    found = warc.read_warc(spark, f"{tmp_path}/a.warc.gz")
    assert found.count() == 2
    out = {r.record_type: r for r in warc.derivatives(found).collect()}
    assert out["conversion"].record.endswith("\r\n\r\nété") and out["conversion"].payload_digest == "sha1:GIVEN" and "source-header: X-A: 1" in out["metadata"].record and "source-header: WARC-Date: 2020-01-01T00:00:00Z" in out["metadata"].record


# ---- queries and pipeline -------------------------------------------------------

SMALL = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.queries()] == [str(k) for k in range(1, 11)]


def test_shared_folder_is_the_session_s(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = common.read(spark, SMALL, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, SMALL))
        assert docs.columns == columns, name
        after = docs.count()
        assert 0.8 * before <= after <= before, name
        before = after
    out = P.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in docs.collect()} and all(0 < r.length <= 2048 for r in out)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "x " * 50_000, None, None, None), (2, "x " * 50_000, None, None, None)], docs.schema)
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, odd, SMALL).columns == columns, name
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name
        stage(spark, odd, SMALL).collect()


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_run(spark):
    import corpus_pipeline as P

    assert len(P.STAGES) == 5 and P.run(spark, SMALL).count() > 100
