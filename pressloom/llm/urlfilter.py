"""URL filters: rules by longest match, else a path-template tree learned per host.

Main path: DataFrame functions only. The tree has a level for each segment of
the deepest path (what lies deeper than ``DEPTH`` is one more segment, whole, so
no branch is left out): path segments of a variable
shape (numbers, hexadecimal names, dates) become wildcards; level by level, a
node whose literal children are many and mostly unique becomes a wildcard too.
Templates of a host that differ in literal segments only are branches: those
whose share of bad labels is within sampling error of their pool's are merged
and judged together, others by themselves. A template (or merged pool) is
rejected where its smoothed purity, the share of good labels shrunk towards the
corpus's, is below one half.

Urls are collapsed to counts of their shapes before any level is built, and
counts are combined before each shuffle, so a host with a third of all urls is
no single task. The verdicts join back by host and shape.

Defined results: host and path of a null url or one without ``://`` are empty
and no rule fits; without labels every purity is one half and the verdict is
allow; null ids and repeated rows are carried along; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import drop, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DEPTH, CHILDREN, WEIGHT, Z2 = 12, 16, 5.0, 3.84
#: Between the segments of what lies deeper, which is one segment of the tree.
DEEPER = "\x01"


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. ``rules``: a short list; of equally long ones that with the longer host wins."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def shapes(path: Column) -> Column:
    """The segments, those of a variable shape as wildcards; what lies deeper than ``DEPTH`` is one more, whole."""
    kind = lambda s: F.when(s.rlike(r"^[0-9]+(\.[a-z]+)?$"), F.regexp_replace(s, "^[0-9]+", "{n}")).when(s.rlike("^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{d}").when(s.rlike("^[0-9a-f-]{8,}$"), "{x}").otherwise(s)
    found = F.filter(F.split(path, "/"), lambda s: s != "")
    of = F.transform(found, kind)
    return let(of, lambda t: F.when(F.size(t) > DEPTH, F.concat(F.slice(t, 1, DEPTH), F.array(F.array_join(F.slice(t, F.lit(DEPTH + 1), F.size(t)), DEEPER)))).otherwise(t))


def templates(seen: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """From (host, shape, n, labelled, bad), one row a shape: adds ``template``; as many levels as the deepest shape has."""
    t = seen.select("host", "shape", "n", F.split("shape", "/").alias("s"), F.lit("").alias("template"))
    deepest = t.agg(F.max(F.size("s"))).first()[0] or 0
    for k in range(1, deepest):
        t = t.withColumn("c", F.get("s", F.lit(k)))
        kids = t.where("c IS NOT NULL AND NOT (c LIKE '{%' OR c LIKE '*%')").groupBy("host", "template", "c").agg(F.sum("n").alias("n"))
        wide = kids.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("n")).where(f"kids > {CHILDREN} AND 2 * kids > n").select("host", "template", F.lit(True).alias("wide"))
        t = t.join(wide, ["host", "template"], "left")
        child = F.when(F.col("wide") & ~F.col("c").like("{%") & ~F.col("c").like("*%"), "*").otherwise(F.col("c"))
        # a level is read twice by the next one: written, the plan stays as large as one level
        t = stored(t.select("host", "shape", "n", "s", F.when(F.col("c").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), child)).alias("template")), keep)
    return t.select("host", "shape", "template")


def purity(good: Column, labelled: Column, prior: Column) -> Column:
    return (good + F.lit(WEIGHT) * prior) / (labelled + F.lit(WEIGHT))


def template_verdicts(seen: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(host, shape, verdict) from the counts of the shapes."""
    of = templates(seen, keep)
    sums = seen.join(of, ["host", "shape"]).groupBy("host", "template").agg(F.sum("labelled").alias("m"), F.sum("bad").alias("b"))
    sums = sums.withColumn("pool", F.regexp_replace("template", r"/[^/{*][^/]*", "/-"))
    everything = seen.agg(F.sum("labelled").alias("all_m"), F.sum("bad").alias("all_b")).select(F.when(F.col("all_m") > 0, (F.col("all_m") - F.col("all_b")) / F.col("all_m")).otherwise(F.lit(0.5)).alias("prior"))
    pools = sums.groupBy("host", "pool").agg(F.sum("m").alias("pm"), F.sum("b").alias("pb"))
    near = sums.join(pools, ["host", "pool"])
    rate = (F.col("pb") + 1.0) / (F.col("pm") + 2.0)
    alike = (F.col("b") - F.col("m") * rate) * (F.col("b") - F.col("m") * rate) <= F.lit(Z2) * F.col("m") * rate * (F.lit(1.0) - rate)
    near = near.select("host", "pool", "template", "m", "b", alike.alias("alike"))
    merged = near.where("alike").groupBy("host", "pool").agg(F.sum("m").alias("am"), F.sum("b").alias("ab"))
    judged = near.join(merged, ["host", "pool"], "left").crossJoin(F.broadcast(everything))  # one row
    m, b = F.when(F.col("alike"), F.col("am")).otherwise(F.col("m")), F.when(F.col("alike"), F.col("ab")).otherwise(F.col("b"))
    verdict = F.when(purity(m - b, m, F.col("prior")) < 0.5, "block").otherwise("allow")
    return of.join(judged.select("host", "template", verdict.alias("verdict")), ["host", "template"]).select("host", "shape", "verdict")


def judge(pages: DataFrame, labels: DataFrame, key: Column, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``.

    ``key`` is an expression over ``url`` that finds a row of ``labels`` (key long, bad boolean).
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"), key.cast("long").alias("key"))
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    base = base.select("page_id", "host", "path", "key", rule.alias("rule"), said.alias("said"), F.concat(F.lit("/"), F.array_join(shapes(F.col("path")), "/")).alias("shape"))
    marks = labels.where("key IS NOT NULL AND bad IS NOT NULL").groupBy("key").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    seen = base.join(marks, "key", "left").groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    keep: list[str] = []
    verdicts = stored(template_verdicts(stored(seen, keep), keep))
    drop(pages.sparkSession, keep)
    out = base.join(verdicts, ["host", "shape"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "verdict").alias("verdict"))


#: The last number in the path, which names a row of the labels.
LAST_NUMBER = r"(?s)^.*?://[^/?#]*[^?#]*?([0-9]{1,18})[^0-9?#/]*/?([?#].*)?$"


def page_key(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, LAST_NUMBER, 1), F.lit("")).try_cast("bigint")


def oracle() -> str:
    """DuckDB SQL for ``judge`` over pages and labels."""
    chain = " ".join(
        f"WHEN (host = '{text[: text.index('/')]}' OR ends_with(host, '.{text[: text.index('/')]}')) AND starts_with(path, '{text[text.index('/') :]}') THEN '{{{0 if said == 'allow' else 1}}}{text}'"
        for said, text in sorted(RULES, key=lambda r: (-len(r[1]), -r[1].index("/")))
    )
    levels = [
        "l0 AS (SELECT host, shape, n, string_split(shape, '/') AS s, '' AS template FROM seen)"
    ]
    for k in range(1, DEPTH + 2):
        lit = "NOT (c LIKE '{%' OR c LIKE '*%')"
        levels.append(f"c{k} AS MATERIALIZED (SELECT *, s[{k + 1}] AS c FROM l{k - 1})")
        levels.append(f"k{k} AS (SELECT host, template, c, sum(n) AS n FROM c{k} WHERE c IS NOT NULL AND {lit} GROUP BY ALL)")
        levels.append(f"w{k} AS MATERIALIZED (SELECT host, template FROM k{k} GROUP BY host, template HAVING count(*) > {CHILDREN} AND 2 * count(*) > sum(n))")
        levels.append(f"l{k} AS MATERIALIZED (SELECT c{k}.host, shape, n, s, CASE WHEN c IS NULL THEN c{k}.template ELSE c{k}.template || '/' || CASE WHEN w{k}.host IS NOT NULL AND {lit} THEN '*' ELSE c END END AS template FROM c{k} LEFT JOIN w{k} ON c{k}.host = w{k}.host AND c{k}.template = w{k}.template)")
    kind = r"CASE WHEN regexp_matches(s, '^[0-9]+(\.[a-z]+)?$') THEN regexp_replace(s, '^[0-9]+', '{n}') WHEN regexp_matches(s, '^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$') THEN '{d}' WHEN regexp_matches(s, '^[0-9a-f-]{8,}$') THEN '{x}' ELSE s END"
    purity_sql = f"((m - b) + {WEIGHT}::DOUBLE * prior) / (m + {WEIGHT}::DOUBLE)"
    return rf"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '') AS h,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
  try_cast(nullif(regexp_extract(url, '{LAST_NUMBER}', 1), '') AS BIGINT) AS key FROM pages),
v AS (SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host, path, key, list_filter(string_split(path, '/'), lambda s: s <> '') AS f FROM u),
w AS (SELECT page_id, host, path, key, CASE {chain} END AS hit,
  '/' || array_to_string(CASE WHEN len(f) > {DEPTH} THEN list_append(list_transform(f[1:{DEPTH}], lambda s: {kind}), array_to_string(list_transform(f[{DEPTH + 1}:], lambda s: {kind}), chr(1))) ELSE list_transform(f, lambda s: {kind}) END, '/') AS shape FROM v),
marks AS (SELECT doc_id AS key, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
seen AS (SELECT host, shape, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM w LEFT JOIN marks USING (key) GROUP BY host, shape),
{", ".join(levels)},
sums AS (SELECT host, template, sum(labelled) AS m, sum(bad) AS b, regexp_replace(template, '/[^/{{*][^/]*', '/-', 'g') AS pool FROM seen JOIN (SELECT host, shape, template FROM l{DEPTH + 1}) USING (host, shape) GROUP BY host, template),
prior AS (SELECT CASE WHEN sum(labelled) > 0 THEN (sum(labelled) - sum(bad))::DOUBLE / sum(labelled) ELSE 0.5 END AS prior FROM seen),
pools AS (SELECT host, pool, (sum(b) + 1.0::DOUBLE) / (sum(m) + 2.0::DOUBLE) AS rate FROM sums GROUP BY host, pool),
near AS (SELECT host, pool, template, m, b, (b - m * rate) * (b - m * rate) <= {Z2}::DOUBLE * m * rate * (1.0::DOUBLE - rate) AS alike FROM sums JOIN pools USING (host, pool)),
merged AS (SELECT host, pool, sum(m) AS am, sum(b) AS ab FROM near WHERE alike GROUP BY host, pool),
j AS (SELECT host, template, CASE WHEN alike THEN am ELSE near.m END AS m, CASE WHEN alike THEN ab ELSE near.b END AS b, prior FROM near LEFT JOIN merged USING (host, pool) CROSS JOIN prior),
verdicts AS (SELECT host, shape, CASE WHEN {purity_sql} < 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM l{DEPTH + 1} JOIN j USING (host, template))
SELECT page_id, w.host, path, hit[4:] AS rule, CASE hit[2] WHEN '0' THEN 'allow' WHEN '1' THEN 'block' ELSE verdict END AS verdict
FROM w LEFT JOIN verdicts ON w.host = verdicts.host AND w.shape = verdicts.shape
"""
