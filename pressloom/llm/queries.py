"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, packing, pii, quality, simhash, substrings, urlfilter, vectors, warc
from .common import read

def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(read(spark, sf_dir, "documents"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(read(spark, sf_dir, "documents"))


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urlfilter.judge(read(spark, sf_dir, "pages"), labels, urlfilter.page_key(F.col("url")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_components(read(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(read(spark, sf_dir, "pages")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(read(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    model = langid.Model.fit(docs.where(~langid.held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    return langid.predictions(docs, model)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.anonymised(read(spark, sf_dir, "documents"), pii.EXAMPLE_KEY)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS c FROM rep, range(0, 5) AS r(k) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c, 0) AS n_repeat_words FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END)
  + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END) AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_lines::BIGINT AS n_lines, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  fail_bits::BIGINT AS fail_bits, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_substrings, op3_urlfilter, op4_packing, op5_vectors, op6_warc, op7_quality, op8_langid, op9_pii, op10_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op3_urlfilter": urlfilter.oracle(), "op5_vectors": vectors.oracle(), "op7_quality": QUALITY_SQL}
