"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Pairs that are compared at once.
PAIRS = 1 << 17


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one is set only where it is unset and all runs on one machine (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    made = "file://" + tempfile.mkdtemp(prefix="pressloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stored(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    The files are replicated as the shared store replicates them, so a lost
    executor costs no recomputation. ``keep`` collects the path, for ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pressloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Remove stored tables that nothing reads any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) as (node long, root long).

    Randomised contraction: each round every node picks, among itself and its
    neighbours, the one whose seeded hash is least; edges are renamed to the
    picks, loops and repeats dropped. A constant share of the nodes goes each
    round whatever the shape, so the rounds are logarithmic in the longest
    path, and each is two equi-joins and two partial aggregates: a hub is
    combined before the shuffle and a hot join key is split by the planner.
    ``root`` is some node of the component, not the least one. Nodes without
    an edge to another node are left out.
    """
    spark = edges.sparkSession
    edges = edges.select("a", "b").where("a <> b").distinct()
    paths: list[str] = []
    edges = stored(edges, paths)
    picks: DataFrame | None = None
    seed = 0
    while not edges.isEmpty():
        seed += 1
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c).alias("h"), F.col(c).alias("v"))
        pick = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m"))
        pick = stored(pick.select("node", F.least("m", rank("node")).getField("v").alias("root")), paths)
        old = edges
        edges = old.join(pick.withColumnsRenamed({"node": "a", "root": "x"}), "a").join(pick.withColumnsRenamed({"node": "b", "root": "y"}), "b")
        edges = stored(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), paths)
        if picks is None:
            picks = pick
        else:
            step = pick.select(F.col("node").alias("root"), F.col("root").alias("next"))
            picks = stored(picks.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), paths)
    if picks is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = stored(picks)
    drop(spark, paths)
    return out


def block_pairs(dealt: DataFrame, bucket: list[str], node: str, block: int) -> DataFrame:
    """Deals the members of each bucket out to pairs of its blocks, so that any two of them meet in one group.

    Adds ``group`` (long) and ``side``: 2 in a block that meets itself, 0 and 1
    on the left and right side of two that meet. A bucket of any size is cut
    into blocks of some ``block`` rows; buckets of one are left out.
    """
    full = dealt.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("__blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    placed = dealt.join(full, bucket).withColumn("__b", F.pmod(F.xxhash64(node), F.col("__blocks")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda o: F.struct(F.least("__b", o).alias("i"), F.greatest("__b", o).alias("j"), F.when(o == F.col("__b"), 2).when(F.col("__b") < o, 0).otherwise(1).alias("side")))
    return placed.withColumn("__p", F.explode(met)).withColumns({"group": F.xxhash64(*bucket, "__p.i", "__p.j"), "side": F.col("__p.side")}).drop("__blocks", "__b", "__p")


def whole_groups(batches):
    """Tables that hold all rows of each of their groups, from batches in order of ``group``."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        group = t.column("group").to_numpy()
        cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if group[0] != group[-1] else 0
        if held and group[0] != held[-1].column("group")[-1].as_py():
            yield pa.concat_tables(held)
            held = []
        if cut:
            yield pa.concat_tables([*held, t.slice(0, cut)])
            held = []
        held.append(t.slice(cut))
    if held:
        yield pa.concat_tables(held)


def pairs(group: np.ndarray, side: np.ndarray):
    """Index pairs that meet: within a group, from both sides or within a block that meets itself; some ``PAIRS`` at a time."""
    at, k, lefts, rights, n = np.arange(len(group)), 0, [], [], 0
    while True:
        k += 1
        at = at[at + k < len(group)]
        at = at[group[at + k] == group[at]]
        if not len(at):
            break
        ok = at[(side[at] == 2) | (side[at] != side[at + k])]
        lefts.append(ok)
        rights.append(ok + k)
        n += len(ok)
        if n >= PAIRS:
            yield np.concatenate(lefts), np.concatenate(rights)
            lefts, rights, n = [], [], 0
    if n:
        yield np.concatenate(lefts), np.concatenate(rights)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that join what the pairs join."""
    parent, out = list(range(n)), []
    for a, b in zip(i.tolist(), j.tolist()):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


_APART = regex.compile(r"(?<=\S) (?=\S)").split
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search


def words_of(text: str) -> list[str]:
    """A text cut before each single space between two characters that are no white space.

    Byte-level pre-tokenisers always cut there, so the words can be encoded by themselves.
    """
    if "  " in text or " \n" in text or "\n " in text or text[:1] in " \n" or text[-1] in " \n" or _ODD(text):
        parts = _APART(text)
        return [parts[0], *[" " + p for p in parts[1:]]]
    parts = text.replace(" ", "\0 ").split("\0") if "\0" not in text else ["", *text.split(" ")]
    return parts if parts[0] else [parts[1], *[" " + p for p in parts[2:]]]
