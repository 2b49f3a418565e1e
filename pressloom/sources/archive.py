"""The web archive: captures by index query, pages by address.

``register`` adds the ``cdx`` data source, one partition for each source and
day. How an address is opened is a parameter, so captured answers can stand in
for the network.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Sequence
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import urls as U

SERVICE = "https://web.archive.org/cdx/search/cdx"
CAPTURE = "timestamp string, original string, statuscode string, mimetype string, digest string, source string, country string, query_day string, year string"
FIELDS = ("timestamp", "original", "statuscode", "mimetype", "digest")
RETRIED, TRIES, BACKOFF = (429, 500, 502, 503, 504), 3, 2.0
Opener = Callable[[str, float], bytes]


def open_url(url: str, timeout: float = 60.0) -> bytes:
    """GET with up to ``TRIES`` retries, each after twice the pause, on errors that may pass."""
    for k in range(TRIES + 1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "pressloom"}), timeout=timeout) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED or k == TRIES:
                raise
        except urllib.error.URLError:
            if k == TRIES:
                raise
        time.sleep(BACKOFF * 2**k / 2)
    raise AssertionError


def query_url(pattern: str, first: str, last: str, limit: int = 100, filters: Sequence[str] = ()) -> str:
    """The index query; ``filters`` as in ``statuscode:200`` or ``mimetype:text/html``."""
    asked = [("url", pattern), ("from", first), ("to", last), ("output", "json"), ("fl", ",".join(FIELDS)), ("limit", str(limit)), *[("filter", f) for f in filters]]
    return SERVICE + "?" + urllib.parse.urlencode(asked)


def capture_rows(payload: bytes) -> list[tuple]:
    """The rows of an answer, a header row first, in the order of ``FIELDS``; none for an empty one."""
    data = json.loads(payload) if payload.strip() else []
    at = [data[0].index(f) if f in data[0] else None for f in FIELDS] if data else []
    return [tuple(None if k is None else row[k] for k in at) for row in data[1:]]


def days(first: str, last: str) -> list[str]:
    """All days from one ``YYYYMMDD`` to another."""
    a, b = (date(int(x[:4]), int(x[4:6]), int(x[6:8])) for x in (first, last))
    return [(a + timedelta(k)).strftime("%Y%m%d") for k in range((b - a).days + 1)]


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Captured answers (payload, source, country, query_day) as captures, inside the JVM."""
    rows = F.from_json("payload", "array<array<string>>")
    table = payloads.withColumn("__rows", F.coalesce(rows, F.array().cast("array<array<string>>"))).where(F.size("__rows") > 1)
    table = table.select("source", "country", "query_day", F.get("__rows", F.lit(0)).alias("__head"), F.explode(F.slice("__rows", F.lit(2), F.size("__rows"))).alias("__row"))
    fields = [F.get("__row", F.array_position("__head", f).cast("int") - 1).alias(f) for f in FIELDS]
    return table.select(*fields, "source", "country", "query_day").withColumn("year", F.substring("timestamp", 1, 4))


class _Query(InputPartition):
    def __init__(self, source: str, domain: str, country: str, day: str):
        self.source, self.domain, self.country, self.day = source, domain, country, day


def register(spark: SparkSession, opener: Opener = open_url) -> None:
    """Adds ``spark.read.format("cdx")`` with options ``sources`` (JSON list of name, domain, country), ``from``, ``to``, ``limit``, ``filters`` (with commas between), ``strict``.

    A query that fails gives no rows, unless ``strict`` is true.
    """

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.sources = json.loads(options["sources"])
            self.first, self.last = options["from"], options["to"]
            self.limit, self.strict = int(options.get("limit", "100")), options.get("strict", "false").lower() == "true"
            self.filters = [f for f in options.get("filters", "").split(",") if f]

        def partitions(self):
            return [_Query(s["name"], s["domain"], s["country"], d) for s in self.sources for d in days(self.first, self.last)]

        def read(self, q):
            try:
                found = capture_rows(opener(query_url(q.domain, q.day, q.day, self.limit, self.filters), 120.0))
            except Exception:
                if self.strict:
                    raise
                found = []
            for row in found:
                yield (*row, q.source, q.country, q.day, (row[0] or "")[:4])

    class Cdx(DataSource):
        @classmethod
        def name(cls):
            return "cdx"

        def schema(self):
            return CAPTURE

        def reader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Cdx)


def fetch(requests: DataFrame, timestamp: str, url: str, opener: Opener = open_url, sleep: float = 1.0) -> DataFrame:
    """Adds ``html`` and ``fetch_error``. Rows that have an error already stay as they are.

    Requests are made one by one within a partition, with a pause; how many run at
    once is the number of partitions.
    """
    base = requests if "fetch_error" in requests.columns else requests.withColumn("fetch_error", F.lit(None).cast("string"))
    base = base.withColumn("__address", U.wayback_raw_url(F.col(timestamp), F.col(url)))

    def run(frames):
        for frame in frames:
            pages, errors = [], []
            for address, error in zip(frame["__address"], frame["fetch_error"]):
                page = None
                if error is None or pd.isna(error):
                    error = None
                    try:
                        time.sleep(sleep)
                        page = opener(address, 60.0).decode("utf-8", "ignore")
                    except Exception as e:  # noqa: BLE001  an error is data here
                        error = f"{type(e).__name__}: {e}"
                pages.append(page)
                errors.append(error)
            yield frame.drop(columns="__address").assign(fetch_error=pd.Series(errors, index=frame.index, dtype=object), html=pd.Series(pages, index=frame.index, dtype=object))

    schema = base.drop("__address").schema.add("html", "string")
    return base.mapInPandas(run, schema)


def fetch_missing(requests: DataFrame, known: DataFrame | None, timestamp: str, url: str, opener: Opener = open_url, sleep: float = 1.0) -> DataFrame:
    """``fetch``, but what is in ``known`` (html_name, html) is taken from there."""
    named = requests.withColumn("html_name", U.cache_name(F.col(timestamp), F.col(url)))
    if known is None:
        return fetch(named, timestamp, url, opener, sleep)
    pages = known.groupBy("html_name").agg(F.max("html").alias("html"))
    there = named.join(pages, "html_name", "left")
    have = there.where("html IS NOT NULL")
    if "fetch_error" not in have.columns:
        have = have.withColumn("fetch_error", F.lit(None).cast("string"))
    return have.unionByName(fetch(there.where("html IS NULL").drop("html"), timestamp, url, opener, sleep))
