"""Embedding near-dedup with randomised-rotation binary codes.

Equal vectors of a label collapse first, with their number. A seeded random
rotation gives each distinct vector its sign code, packed into 64-bit words, and
a correction factor, the inner product of the vector with its code. Both are
stored once, with the rotated vector in eight bit planes. The inner product of
one vector's code with another's planes is then a matter of bit counts; divided
by the factor it estimates the cosine without bias, and the factor bounds the
error for any pair at the threshold. Vectors without an undecided pair are done;
the others are read exactly, and their pairs computed in double precision. The
bound is certain, not just likely, so no link is lost to the estimate.

Candidates lose none either. A label's vectors are cut into blocks of ``BLOCK``
that meet two by two, and each pair of blocks is one group. There the first
``HEAD`` rotated dimensions of all pairs are multiplied at once, as matrices:
two unit vectors at the threshold are at most ``sqrt(2 - 2 threshold)`` apart, and
no further in those dimensions. What that leaves is judged by codes and planes.
A vector is sent once for each block of its label, in some 200 bytes, and its
components only for groups in which it has an undecided pair. Pairs grow with the
square of a label at about a nanosecond each; neither the number of vectors nor
chance decides what is found.

Exact cosines are matrix products as well, and those within ``EPS`` of the
threshold are computed again one by one; tasks return counts and a spanning
forest of their links, never pairs. ``reached`` and ``home`` deal vectors to
buckets of sign patterns that cover the threshold; at ``THRESHOLD`` that takes
some 126 rows of a vector in 64 dimensions, so the query does not use it.

Defined results: null, zero, empty or non-finite vectors, those with null label
and those with null ``vec_id`` link with nothing (component: their own id);
vectors of different lengths never link; rows that repeat a ``vec_id`` are
vectors each, with a result each; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PAIRS, block_pairs, components, drop, runs, stored, whole_groups

THRESHOLD, SEED, BITS, BLOCK, PLANES = 0.98, 11, 16, 1 << 17, 8
#: Rotated dimensions that are compared first; rows and columns that are multiplied at once; room for rounding there.
HEAD, TILE, ROUGH = 16, (1024, 4096), 1e-5
#: Room for rounding in what must not be missed.
EPS = 1e-9

@lru_cache(8)
def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def stripes(d: int) -> np.ndarray:
    """First dimension of each stripe."""
    return np.arange(0, d, BITS)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    width = -(-bits.shape[1] // 64) * 64
    wide = np.zeros((len(bits), width), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def codes(turned: np.ndarray) -> dict[str, np.ndarray]:
    """Sign code, factor, bit planes, and the least value and step that the planes count in."""
    d = turned.shape[1]
    signs = turned > 0
    factor = np.where(signs, turned, -turned).sum(1) / np.sqrt(d)
    low = turned.min(1)
    step = np.maximum(turned.max(1) - low, 1e-30) / ((1 << PLANES) - 1)
    level = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, (1 << PLANES) - 1).astype(np.int64)
    planes = np.stack([packed((level >> p) & 1) for p in range(PLANES)], 1)
    return {"code": packed(signs), "factor": factor, "planes": planes, "low": low, "step": step}


def estimates(c: dict[str, np.ndarray], d: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cosine of pairs as estimated from the code of i and the planes of j, and the error the planes can add."""
    code = c["code"][i]
    inside = sum((np.bitwise_count(code & c["planes"][j, p]).sum(1, dtype=np.int64) << p) for p in range(PLANES))
    ones = np.bitwise_count(code).sum(1, dtype=np.int64)
    total = sum(np.bitwise_count(c["planes"][j, p]).sum(1, dtype=np.int64) << p for p in range(PLANES))
    low, step, factor = c["low"][j], c["step"][j], c["factor"][i]
    inner = (2 * (low * ones + step * inside) - (low * d + step * total)) / np.sqrt(d)
    return inner / factor, np.sqrt(d) * step / 2 / factor


def possible(c: dict[str, np.ndarray], d: int, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the estimates, either way, leave room for a cosine at the threshold."""
    ok = np.ones(len(i), bool)
    for a, b in ((i, j), (j, i)):
        about, blur = estimates(c, d, a, b)
        f = c["factor"][a]
        slack = np.sqrt(max(0.0, 1 - threshold**2) * np.maximum(0, 1 - f * f)) / f + blur + EPS
        ok &= about >= threshold - slack
    return ok


def reached(turned: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every bucket of every rotated unit vector."""
    starts, out = stripes(turned.shape[1]), []
    most = (2 - 2 * threshold) / len(starts) / 4 + EPS
    for t, at in enumerate(starts.tolist()):
        part = turned[:, at : at + BITS]
        small = part * part
        rows = np.arange(len(part))
        key = ((part > 0) @ (1 << np.arange(part.shape[1], dtype=np.int64))) | (t << BITS)
        used = np.zeros(len(part))
        for k in range(part.shape[1]):
            ok = used + small[rows, k] <= most
            rows, key, used = np.concatenate((rows, rows[ok])), np.concatenate((key, key[ok] ^ (1 << k))), np.concatenate((used, used[ok] + small[rows[ok], k]))
        out.append((rows, key))
    return tuple(np.concatenate(p) for p in zip(*out))


def home(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """The one bucket in which each pair of rotated vectors counts."""
    starts = stripes(x.shape[1])
    apart = np.add.reduceat((x - y) ** 2, starts, axis=1) <= (2 - 2 * threshold) / len(starts) + EPS
    t = apart.argmax(1)
    at = starts[t][:, None] + np.arange(BITS)
    inside = at < x.shape[1]
    at = np.minimum(at, x.shape[1] - 1)
    row = np.arange(len(x))[:, None]
    bits = ((x[row, at] + y[row, at]) > 0) & inside
    return (bits @ (1 << np.arange(BITS, dtype=np.int64))) | (t << BITS)


def rows_of(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """A column of equally long binary values or lists as a matrix."""
    c = column.combine_chunks()
    if pa.types.is_binary(c.type):
        return np.frombuffer(b"".join(c.to_pylist()), kind).reshape(len(c), -1)
    return c.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(c), -1)


def by_length(column: pa.Array):
    """(rows, matrix) of the lists of each length."""
    lengths = np.array([len(v) for v in column], np.int64)
    for d in np.unique(lengths).tolist():
        where = np.flatnonzero(lengths == d)
        yield where, column.take(pa.array(where)).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(where), d)


CODED = "node long, code binary, factor double, planes binary, low double, step double, head binary"


def coded(distinct: DataFrame) -> DataFrame:
    """The code, factor and planes of each vector, and the first of its rotated dimensions; from (node, v)."""

    def run(batches):
        for b in batches:
            for where, v in by_length(b.column(1)):
                turned = unit(v) @ rotation(v.shape[1])
                c = codes(turned)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(where)), pa.array([r.tobytes() for r in c["code"]], pa.binary()), pa.array(c["factor"]), pa.array([r.tobytes() for r in c["planes"]], pa.binary()), pa.array(c["low"]), pa.array(c["step"]), pa.array([r.tobytes() for r in turned[:, :HEAD].astype("<f4")], pa.binary())],
                    [f.split()[0] for f in CODED.split(", ")],
                )

    return distinct.select("node", "v").mapInArrow(run, CODED)


def tiles(group: np.ndarray, side: np.ndarray):
    """(rows, columns) of the parts of all pairs that meet; a block that meets itself gives each row the columns from its tile's first on."""
    for a, b in zip(cuts := runs(group), cuts[1:]):
        own = np.arange(a, b)
        inside, left, right = (own[side[a:b] == k] for k in (2, 0, 1))
        for x, y, alone in ((inside, inside, True), (left, right, False)):
            for at in range(0, len(x), TILE[0]):
                for to in range(at if alone else 0, len(y), TILE[1]):
                    yield x[at : at + TILE[0]], y[to : to + TILE[1]], alone


def near_heads(head: np.ndarray, group: np.ndarray, side: np.ndarray, threshold: float):
    """Index pairs that are near enough in the dimensions of ``head``, a tile at a time."""
    half, one = (head * head).sum(1, keepdims=True) / 2, np.ones((len(head), 1), np.float32)
    left, right = np.hstack((head, -half, one)), np.hstack((head, one, -half))
    for rows, columns, alone in tiles(group, side):
        at = np.flatnonzero(left[rows] @ right[columns].T >= threshold - 1 - ROUGH)
        if len(at):
            i, j = rows[at // len(columns)], columns[at % len(columns)]
            yield (i[i < j], j[i < j]) if alone else (i, j)


def undecided(met: DataFrame, threshold: float) -> DataFrame:
    """(group, side, node) of the members of a group that have an undecided pair there, by the stored heads and codes alone."""

    def run(batches):
        for t in whole_groups(batches):
            for table in of_one_length(t):
                group, side, d = table.column("group").to_numpy(), table.column("side").to_numpy(), int(table.column("d")[0].as_py())
                c = {k: table.column(k).to_numpy() for k in ("factor", "low", "step")} | {"code": rows_of(table.column("code"), "<u8")}
                c["planes"] = rows_of(table.column("planes"), "<u8").reshape(len(group), PLANES, -1)
                some = np.zeros(len(group), bool)
                for i, j in near_heads(rows_of(table.column("head"), "<f4"), group, side, threshold):
                    while len(i):
                        new = ~(some[i] & some[j])
                        i, j = i[new], j[new]
                        a, b, i, j = i[:PAIRS], j[:PAIRS], i[PAIRS:], j[PAIRS:]
                        ok = possible(c, d, a, b, threshold)
                        some[a[ok]] = some[b[ok]] = True
                yield pa.RecordBatch.from_arrays([pa.array(table.column(k).to_numpy()[some], t) for k, t in kinds.items()], list(kinds))

    kinds = {"group": pa.int64(), "side": pa.int32(), "node": pa.int64()}
    return met.select("group", "side", "node", "d", "code", "factor", "planes", "low", "step", "head").mapInArrow(run, "group long, side int, node long")


def of_one_length(t: pa.Table):
    d = t.column("d").to_numpy()
    for k in np.unique(d).tolist():
        yield t.filter(pa.array(d == k)) if (d != k).any() else t


def exact(met: DataFrame, threshold: float) -> DataFrame:
    """(node, other, n): links among undecided members, computed exactly, as a forest, and counts with ``other`` null."""

    def run(batches):
        for t in whole_groups(batches):
            for table in of_one_length(t):
                group, side, node, m = (table.column(k).to_numpy() for k in ("group", "side", "node", "m"))
                x, many = unit(rows_of(table.column("v"), "<f8")), m.astype(np.float64)
                count, of, links = np.zeros(len(group)), np.arange(len(group)), []
                for rows, columns, alone in tiles(group, side):
                    cosine = x[rows] @ x[columns].T
                    near = cosine >= threshold
                    i, j = np.nonzero(np.abs(cosine - threshold) <= EPS)
                    near[i, j] = np.einsum("ij,ij->i", x[rows[i]], x[columns[j]]) >= threshold
                    if alone:
                        near &= rows[:, None] < columns
                    count[rows] += near @ many[columns]
                    count[columns] += many[rows] @ near
                    for k in np.flatnonzero(near.any(1)).tolist():
                        others = columns[near[k]]
                        others = others[of[others] != of[rows[k]]]
                        if len(others):
                            joined, first = np.unique(of[others], return_index=True)
                            links += [(int(rows[k]), o) for o in others[first].tolist()]
                            of[np.isin(of, joined)] = of[rows[k]]
                some = np.flatnonzero(count)
                a, b = node[[p for p, _ in links]], node[[q for _, q in links]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((node[some], a))), pa.array([None] * len(some) + b.tolist(), pa.int64()), pa.array(count[some].astype(np.int64).tolist() + [None] * len(a), pa.int64())], ["node", "other", "n"])

    return met.select("group", "side", "node", "d", "m", "v").mapInArrow(run, "node long, other long, n long")


def links(distinct: DataFrame, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(node, other, n) over distinct vectors (node long, label, m long, v array<float> or array<double>)."""
    paths: list[str] = []
    known = stored(coded(distinct), paths)
    met = block_pairs(distinct.select("node", "label", F.size("v").alias("d")), ["label", "d"], "node", BLOCK).select("group", "side", "node", "d")
    parts = max(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    sorted_by = lambda df: df.repartition(parts, "group").sortWithinPartitions("group")
    open_ones = stored(undecided(sorted_by(met.join(known, "node")), threshold), keep)
    drop(known.sparkSession, paths)
    return exact(sorted_by(open_ones.join(distinct.select("node", F.size("v").alias("d"), "m", "v"), "node")), threshold)


def near_components(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label)."""
    keep: list[str] = []
    kind = "float" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), True) else "double"  # floats travel as such, cosines are double
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"), F.col("label").cast("string").alias("label"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda a: a != 0), F.lit(False))
    rows = rows.select("vec_id", "label", F.when(sound, F.transform("v", lambda a: a + F.lit(0.0).cast(kind))).alias("v"))
    same = rows.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("m"))
    same = stored(same.withColumn("node", F.monotonically_increasing_id()), keep)  # written, so a node keeps its number
    found = stored(links(same, keep, threshold), keep)
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked = found.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("n"))
    joined = same.select("node", "least", "m").join(linked, "node", "left").join(roots, "node", "left").select("node", "least", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    joined = joined.where("n_links > 0")  # the others are components by themselves
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = same.select("node", "label", "v").join(joined.join(least, "root"), "node").select("label", "v", "n_links", "component_id")
    out = rows.join(of, ["label", "v"], "left")
    out = stored(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
    drop(rows.sparkSession, keep)
    return out


def oracle() -> str:
    """DuckDB SQL for ``near_components`` over embeddings: all pairs of a label."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings AS e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
