"""New runs as they arrive: each batch of article files is classified and merged.

The batch plans are the same as those of ``plans``; a stream only decides when
a folder is read. With ``available_now`` it takes what is there and stops.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.lexicon import Lexicon
from ..plans.stages import classify
from ..sources import tables


def classified_stream(spark: SparkSession, path: str, schema: StructType | str, lexicon: Lexicon, files_per_batch: int = 1000) -> DataFrame:
    """Articles under ``path`` (a glob of runs) as a stream with retrieval scores and ``run_id``."""
    articles = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).parquet(path)
    articles = articles.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), "/data/runs/([^/]+)/", 1))
    return classify(articles, lexicon, show_terms=False)


def append(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Adds every classified row to a table, once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def bucket_counts(stream: DataFrame, delay: str = "1 day", width: str = "30 days") -> DataFrame:
    """Articles by bucket in windows of capture time; what is later than ``delay`` no longer counts."""
    timed = stream.withColumn("captured", F.try_to_timestamp(F.substring("snapshot_timestamp", 1, 14), F.lit("yyyyMMddHHmmss"))).withWatermark("captured", delay)
    return timed.groupBy(F.window("captured", width), "retrieval_bucket").agg(F.count(F.lit(1)).alias("n"))


def merge_unique(stream: DataFrame, path: str, checkpoint: str, unique) -> StreamingQuery:
    """Keeps a table of unique articles up to date: ``unique`` (rows to one row a key) over old and new rows of each batch.

    The table's version names the batch it came from, so a batch that is
    replayed after a failure changes nothing.
    """
    stream_name = hashlib.md5(checkpoint.encode()).hexdigest()

    def merge(batch: DataFrame, number: int) -> None:
        spark, mark = batch.sparkSession, f"{stream_name}-{number}"
        tables.recover(spark, path)
        if tables.marked(spark, path, mark):
            return
        both = batch if not tables.exists(spark, path) else tables.parquet(spark, path).unionByName(batch, allowMissingColumns=True)
        tables.replace(unique(both), path, mark)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
