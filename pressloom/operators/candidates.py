"""From archived homepages to candidate links, and from fetched articles to texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..functions import urls as U
from .articles import first_of, first_rows

CANDIDATE = "source string, country string, snapshot_timestamp string, homepage_url string, candidate_url string, anchor_text string"


def unique_snapshots(snapshots: DataFrame) -> DataFrame:
    """One row for each capture; of repeats the one asked for first."""
    keys = ("timestamp", "original", "digest", "source")
    return first_rows(snapshots, keys, [X.blank(F.col("query_day"))] if "query_day" in snapshots.columns else [])


def with_links(homepages: DataFrame) -> DataFrame:
    """Adds ``links``: the internal links of (source, country, timestamp, original, html), resolved and unwrapped."""
    return homepages.withColumn("links", H.links_in(F.col("html")))


def links(homepages: DataFrame) -> DataFrame:
    """A row for each internal link of the pages, in no order; repeats stay."""
    each = with_links(homepages).select("source", "country", F.col("timestamp").alias("snapshot_timestamp"), F.col("original").alias("homepage_url"), F.explode("links").alias("link"))
    each = each.where(X.strip(X.blank(F.col("link.href"))) != "")
    resolved = each.withColumn("candidate_url", H.resolve(F.col("homepage_url"), U.unwrap_wayback(F.col("link.href"))))
    return resolved.where(U.is_internal(F.col("candidate_url"), F.col("homepage_url"))).select("source", "country", "snapshot_timestamp", "homepage_url", "candidate_url", X.strip(X.blank(F.col("link.anchor"))).alias("anchor_text"))


def homepage_candidates(found: DataFrame) -> DataFrame:
    """One row for each source and address, the earliest capture's."""
    return first_rows(found, ("source", "candidate_url"), [X.blank(F.col("snapshot_timestamp")), X.blank(F.col("homepage_url"))])


def diagnostics(homepages: DataFrame) -> DataFrame:
    """A row for each capture with its error, size and number of internal links; ``fetch_error`` is null for fetched ones."""
    base = with_links(homepages)
    inside = F.filter("links", lambda x: U.is_internal(absolute(F.col("original"), U.unwrap_wayback(X.blank(x["href"]))), F.col("original")) & (X.strip(X.blank(x["href"])) != ""))
    size = F.octet_length(X.blank(F.col("html")))
    return base.select("source", "country", "timestamp", "original", "fetch_error", F.lit(None).cast("string").alias("extract_error"), F.when(F.col("fetch_error").isNull(), U.cache_name(F.col("timestamp"), F.col("original"))).otherwise("").alias("html_path"), size.cast("long").alias("html_size_bytes"), F.size(inside).cast("long").alias("links_extracted"))


def absolute(base: Column, href: Column) -> Column:
    """Enough of the resolution to compare hosts: schemes and hosts of absolute and scheme-relative addresses, else the base's."""
    own = U.part(href, 1)
    return F.when(own != "", href).when(href.startswith("//"), F.concat(U.part(base, 1), F.lit(":"), href)).otherwise(base)


def clean_candidates(candidates: DataFrame) -> DataFrame:
    """Links that look like articles, with ``normalized_url``, one row for each source and address."""
    kept = candidates.where(U.looks_like_article(F.col("candidate_url"), F.col("anchor_text")))
    kept = kept.withColumn("normalized_url", U.normalize_url(F.col("candidate_url"))).where(~U.is_no_article(F.col("normalized_url")))
    return first_rows(kept, ("source", "normalized_url"), [X.blank(F.col("snapshot_timestamp")), X.blank(F.col("candidate_url"))])


def article_requests(clean: DataFrame) -> DataFrame:
    """Adds what to fetch, and the error of rows that cannot be fetched."""
    url = first_of(clean, ("normalized_url", "candidate_url"))
    error = F.when(url == "", "missing_article_url").when(X.blank(F.col("snapshot_timestamp")) == "", "missing_snapshot_timestamp")
    return clean.withColumns({"article_url": url, "fetch_error": error, "html_name": F.when(error.isNull(), U.cache_name(F.col("snapshot_timestamp"), url)).otherwise("")})


def parsed(fetched: DataFrame) -> DataFrame:
    """Title, text and length from ``html``; empty where fetching failed."""
    ok = F.col("fetch_error").isNull()
    page = H.parse_article(F.when(ok, F.col("html")))
    out = fetched.withColumn("__page", page)
    return out.withColumns({"title": F.when(ok, F.col("__page.title")).otherwise(""), "text": F.when(ok, F.col("__page.text")).otherwise(""), "text_length": F.when(ok, F.col("__page.text_length")).otherwise(0)}).drop("__page", "html")


def failed(articles: DataFrame) -> DataFrame:
    return articles.where("fetch_error IS NOT NULL")


def merged_retry(articles: DataFrame, again: DataFrame) -> DataFrame:
    """The articles with the retried rows in place of the failed ones; a retry has the same columns."""
    return articles.where("fetch_error IS NULL").unionByName(again)


def retry_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, n) of a retry pass."""
    a = before.agg(F.count_if(F.col("fetch_error").isNotNull()).alias("errors_before_retry"))
    b = after.agg(F.count(F.lit(1)).alias("articles_processed"), F.count_if(F.col("fetch_error").isNotNull()).alias("errors_after_retry"), F.count_if(F.length(X.blank(F.col("text"))) > 0).alias("articles_with_text"))
    both = a.join(F.broadcast(b))  # a row each
    both = both.withColumn("recovered", F.col("errors_before_retry") - F.col("errors_after_retry"))
    return both.unpivot([], both.columns, "metric", "n")
