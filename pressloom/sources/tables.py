"""Reading and writing tables, wherever Spark can reach them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def parquet_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """An empty table where there is none, or none that can be read."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    try:
        return spark.read.parquet(path)
    except Exception:  # noqa: BLE001  a report goes on without a stage whose table is broken
        return spark.createDataFrame([], schema)


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """With a header line, quotes doubled in quotes, line ends in quotes; all strings without a schema. A byte-order mark is skipped."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    return (reader.schema(schema).option("enforceSchema", False) if schema else reader).csv(path)


def csv_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    try:
        return csv(spark, path)
    except Exception:  # noqa: BLE001  as above
        return spark.createDataFrame([], schema)


def runs(spark: SparkSession, root: str, stage_path: str = "processed/articles_classified.parquet") -> DataFrame:
    """The tables of all runs below ``root`` together, each row with its ``run_id``; columns may differ."""
    df = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{root}/data/runs/*/{stage_path}")
    return df.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), "/data/runs/([^/]+)/", 1))


def write(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """Text fields quoted as ``csv`` reads them. ``bom`` marks the header for spreadsheet programs."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    flat = df.select(*[F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(f"`{c}`") for c in df.columns])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def save(df: DataFrame, parquet_path: str, csv_path: str | None = None) -> None:
    write(df, parquet_path)
    if csv_path:
        write_csv(parquet(df.sparkSession, parquet_path), csv_path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _rename(fs, p, old: str, new: str) -> None:
    if not fs.rename(p(old), p(new)):
        raise OSError(f"could not rename {old} to {new}")


def recover(spark: SparkSession, path: str) -> None:
    """Put a table back that a ``replace`` had set aside when it stopped; drop the rest of one that came through."""
    fs, p = _fs(spark, path)
    if fs.exists(p(f"{path}.old")):
        if fs.exists(p(path)):
            fs.delete(p(f"{path}.old"), True)
        else:
            _rename(fs, p, f"{path}.old", path)


def replace(df: DataFrame, path: str, mark: str | None = None) -> None:
    """Overwrites a table that ``df`` itself may read: a new version beside it, then a swap.

    The old version is only set aside, so wherever this stops, ``recover``, which
    comes first the next time, finds a whole table. ``mark`` names an empty file
    that comes and goes with this version (``marked``).
    """
    spark = df.sparkSession
    fs, p = _fs(spark, path)
    recover(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    if mark:
        fs.create(p(f"{path}.new/_{mark}"), True).close()
    if fs.exists(p(path)):
        _rename(fs, p, path, f"{path}.old")
    _rename(fs, p, f"{path}.new", path)
    fs.delete(p(f"{path}.old"), True)
    spark.catalog.refreshByPath(path)


def marked(spark: SparkSession, path: str, mark: str) -> bool:
    """Whether the table's version carries a mark."""
    return exists(spark, f"{path}/_{mark}")
