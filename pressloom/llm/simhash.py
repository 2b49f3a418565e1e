"""SimHash near-dedup by covering locality-sensitive hashing.

``fingerprints`` gives each text a 64-bit SimHash. ``near_components`` links
fingerprints that differ in at most two bits and returns the connected groups.

Seven tables keep the bits picked by a structured mask each: bit ``i`` carries
a nonzero vector ``m(i)`` of three bits, and table ``v`` keeps the bits with
odd ``<m(i), v>``. Two differing bits span at most two dimensions, so some
``v`` is orthogonal to both and its table maps the two fingerprints to one
bucket: no pair within the radius is missed. The links come out of the buckets:
one of any size is cut into blocks that are compared two by two, and tasks
return a spanning forest, never pairs.

``similar_groups`` links texts whose sets of shingles have a Jaccard similarity
of 0.8 or more, which is far beyond two bits. Candidates come from fingerprints
of 256 bits that differ in no more than all but some 3 in 100,000 pairs at the
similarity sought do (``widest``), among texts that share one of ``BANDS`` keys,
each made of the least of the shingles in ``DEPTH`` orders. A pair of similarity
``s`` shares a key in ``1 - (1 - s^DEPTH)^BANDS`` of cases, 99.93 % at 0.8 and
more above (``tests`` measure it); texts without a common shingle share none, so
buckets grow with the copies of a text and not with the corpus, whatever its
size. Candidates only say which texts are compared: within what they connect,
pairs with fingerprints that near are decided by the shingle sets themselves,
nearest first, block by block, and only what reaches the similarity links. Texts
are sent only to blocks in which they have such a pair.

Defined results: a null or word-less text has fingerprint zero, linked like any
other; a null ``doc_id`` has a fingerprint, but takes no part in links and its
component is null; repeated ``doc_id`` rows each get a row; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_pairs, components, drop, forest, pairs, runs, stored, whole_groups

WORDS, SEED, RADIUS = 3, 42, 2
#: The wide fingerprint's 64-bit parts, its stripes, rows of a block of fingerprints, and of one of texts.
LANES, STRIPES, ROWS, TEXTS = 4, 7, 4096, 512
#: Keys of a set of shingles, the orders that each takes the least of, and rows of a bucket up to which all pairs are taken at once.
BANDS, DEPTH, FEW = 24, 6, 64
_ODD = [np.uint64(x) for x in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_ORDERS = np.random.default_rng(17).integers(0, 2**63, (BANDS * DEPTH, 1), np.uint64) * np.uint64(2) + np.uint64(1)
BLOCK = 1 << 18


def shingle_hashes(text: str | None, words: int):
    """XXH64 of the word shingles, repeats included, in blocks; nothing for a text without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[:n].tolist()
    ends = ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(begins[at : at + BLOCK], ends[at : at + BLOCK])], np.uint64)


def majority(hashes) -> np.ndarray:
    """The bits set in over half of the hashes, given as blocks of rows of 64-bit numbers; as numbers."""
    ones, n, lanes = None, 0, 1
    for h in hashes:
        lanes = 1 if h.ndim == 1 else h.shape[1]
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1)
        ones = bits.sum(0, dtype=np.int64) + (0 if ones is None else ones)
        n += len(h)
    return np.zeros(lanes, np.uint64) if ones is None else np.packbits(ones * 2 > n).view(">u8").astype(np.uint64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the word shingles, repeats included, as an unsigned integer."""
    return int(majority(shingle_hashes(text, words))[0])


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of the word shingles, in order."""
    parts = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets of shingles apart, as two signed numbers."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), "<i8").tolist())


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """SimHash of ``LANES`` times 64 bits over a set of shingles, the least one twice where their number is even."""

    def lanes():
        odd = np.append(h, h[: (len(h) + 1) % 2])  # an odd number leaves no bit undecided
        for at in range(0, len(odd), BLOCK >> 2):
            x = odd[at : at + (BLOCK >> 2), None] * np.array(_ODD)
            x ^= x >> np.uint64(31)
            x *= _ODD[2]
            yield x ^ (x >> np.uint64(29))

    found = majority(lanes())
    return found if len(found) == LANES else np.zeros(LANES, np.uint64)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long: the 64 bits as a signed number) for each row."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(bits: int = 64) -> list[int]:
    """The seven masks, as signed numbers."""
    masks = []
    for v in range(1, 8):
        m = sum(1 << i for i in range(bits) if bin((i % 7 + 1) & v).count("1") % 2)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def close(t: pa.Table, columns: list[str], most: int):
    """(i, j) of the pairs of a table of whole groups whose fingerprints differ in at most so many bits, some at a time."""
    wide = np.stack([t.column(c).to_numpy() for c in columns], 1).view(np.uint64)
    for i, j in pairs(t.column("group").to_numpy(), t.column("side").to_numpy()):
        far = np.zeros(len(i), np.uint16)
        for k in range(len(columns)):
            far += np.bitwise_count(wide[i, k] ^ wide[j, k])
        near = far <= most
        yield i[near], j[near]


def spanned(t: pa.Table, columns: list[str], most: int):
    """(i, j) of pairs as of ``close`` that join what all of them join; rows that are joined are not compared again."""
    group, side = t.column("group").to_numpy(), t.column("side").to_numpy()
    wide = np.stack([t.column(c).to_numpy() for c in columns], 1).view(np.uint64)
    cuts = runs(group)
    large = np.diff(cuts) > FEW
    few = np.flatnonzero(np.repeat(~large, np.diff(cuts)))
    for i, j in close(t.take(pa.array(few)), columns, most):
        yield few[i], few[j]
    for a, b in zip(cuts[:-1][large].tolist(), cuts[1:][large].tolist()):
        of, codes, sides = np.arange(b - a), wide[a:b], side[a:b]
        for k in range(b - a):
            others = np.flatnonzero((of != of[k]) & ((sides == 2) | (sides != sides[k])))
            near = others[np.bitwise_count(codes[others] ^ codes[k]).sum(1, dtype=np.int64) <= most]
            if len(near):
                joined, first = np.unique(of[near], return_index=True)
                of[np.isin(of, joined)] = of[k]
                yield np.full(len(first), a + k), a + near[first]
                if (of == of[0]).all():
                    break


def bucket_links(dealt: DataFrame, bucket: list[str], node: str, columns: list[str], most: int, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that join what is close within the buckets: a spanning forest for each block pair; ``known`` has the node and columns of what is dealt, if ``dealt`` hasn't."""

    def run(batches):
        for t in whole_groups(batches):
            nodes, found = t.column("node").to_numpy(), []
            for i, j in spanned(t, columns, most):
                found += forest(i, j, t.num_rows)
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            links = np.array(forest(a, b, t.num_rows), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[links[:, 0]]), pa.array(nodes[links[:, 1]])], ["a", "b"])

    met = block_pairs(dealt, bucket, node, ROWS)
    met = met.withColumn("node", F.col(node)) if known is None else met.join(known, node)
    met = met.select("group", "side", "node", *[c for c in columns if c != "node"])
    return by_group(met).mapInArrow(run, "a long, b long")


def by_group(met: DataFrame) -> DataFrame:
    return met.repartition(max(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8), "group").sortWithinPartitions("group")


def near_edges(fps: DataFrame) -> DataFrame:
    """Links (a, b) that join all of the distinct ``fp`` within two bits of each other; every link is such a pair."""
    tables = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in covering_masks()])).alias("t", "k"))
    return bucket_links(tables, ["t", "k"], "fp", ["node"], RADIUS)


def near_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``."""
    keep: list[str] = []
    prints = stored(fingerprints(docs, words), keep)
    known = prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_edges(known.select("fp")))
    grouped = known.join(roots, known.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of = grouped.join(least, "root").select("fp", "component_id")
    out = prints.join(of, "fp", "left")
    out = stored(out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")))
    drop(docs.sparkSession, keep)
    return out


def widest(similarity: float) -> int:
    """Differing bits of the wide fingerprint up to which texts are candidates: four deviations above the mean at a Jaccard similarity."""
    bits = 64 * LANES
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + 4 * math.sqrt(bits * p * (1 - p)))


def band_keys(h: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of a set of shingles: sets of a Jaccard similarity s share each with a chance of s to the power ``DEPTH``."""
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 512):
        least = np.minimum(least, (_ORDERS * h[at : at + 512]).min(1))
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, DEPTH))], np.uint64)


def stripe_keys(wide: np.ndarray, d: int) -> np.ndarray:
    """The keys of fingerprints (rows) in tables that miss no pair with less than ``d * STRIPES`` differing bits: the bits of each stripe under each of its masks.

    ``similar_groups`` does not deal by them: there are few keys, so the pairs in
    their buckets grow with the square of the corpus.
    """
    width = min(64 * LANES // STRIPES, round(6.25 * d))
    bits = np.unpackbits(wide.astype(">u8").view(np.uint8).reshape(len(wide), -1), axis=1)
    places = 1 << np.arange(width, dtype=np.int64)
    masks = np.array([sum(1 << i for i in range(width) if bin((i % (2**d - 1) + 1) & v).count("1") % 2) for v in range(1, 2**d)], np.int64)
    stripes = [bits[:, k * width : (k + 1) * width].astype(np.int64) @ places for k in range(STRIPES)]
    return np.hstack([x[:, None] & masks for x in stripes])


def similar_links(t: pa.Table, words: int, similarity: float, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of texts at the similarity within one block, or between two, by their shingle sets."""
    lanes = [f"w{k}" for k in range(LANES)]
    seen, sides, nodes, sets, wide = set(), [], [], [], []
    for b in t.select(["side", "node", "s0", "s1", "text", *lanes]).to_batches(max_chunksize=64):
        for side, node, s0, s1, text, *w in zip(*(c.to_pylist() for c in b.columns)):
            # a repeated doc_id brings other texts along, or the same one again
            if (side, node, s0, s1) not in seen and set_digest(h := shingle_set(text, words)) == (s0, s1) and len(h):
                seen.add((side, node, s0, s1))
                sides.append(side)
                nodes.append(node)
                sets.append(h)
                wide.append(w)
    left, right = [k for k, x in enumerate(sides) if x != 1], np.array([k for k, x in enumerate(sides) if x != 0], np.int64)
    if not left or not len(right):
        return []
    wide = np.array(wide, np.int64).view(np.uint64)
    sizes, group, found = np.array([len(h) for h in sets], np.int64), np.arange(len(sets)), []
    for i in left:
        open_ones = right[(group[right] != group[i]) & (np.minimum(sizes[right], sizes[i]) >= similarity * np.maximum(sizes[right], sizes[i]) - 1e-9)]
        far = np.bitwise_count(wide[open_ones] ^ wide[i]).sum(1, dtype=np.int64)
        for j in open_ones[np.argsort(far, kind="stable")][: int((far <= most).sum())].tolist():
            if group[i] == group[j]:
                continue
            at = np.searchsorted(sets[i], sets[j])
            at[at == sizes[i]] = 0
            both = int((sets[i][at] == sets[j]).sum())
            if both >= similarity * (sizes[i] + sizes[j] - both) - 1e-9:
                group[group == group[j]] = group[i]
                found.append((nodes[i], nodes[j]))
    return found


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs``; texts without a word form one group."""
    keep: list[str] = []
    most = widest(similarity)
    lanes, digest = [f"w{k}" for k in range(LANES)], ["s0", "s1"]
    of = ", ".join(f"{c} long" for c in lanes)

    def prints(batches):
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column(1).to_pylist()]
            w = np.array([wide_fingerprint(h) for h in sets], np.uint64).reshape(-1, LANES).view(np.int64)
            s = np.array([set_digest(h) for h in sets], np.int64).reshape(-1, 2)
            keys = np.array([band_keys(h) for h in sets], np.uint64).view(np.int64)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(w[:, k]) for k in range(LANES)], *[pa.array(s[:, k]) for k in range(2)], keys], ["doc_id", *lanes, *digest, "keys"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    wide = stored(texts.mapInArrow(prints, f"doc_id long, {of}, s0 long, s1 long, keys array<long>"), keep)
    known = stored(wide.where("doc_id IS NOT NULL").groupBy(*digest, *lanes).agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")), keep)

    def open_ones(batches):
        for t in whole_groups(batches):
            some = np.zeros(t.num_rows, bool)
            for i, j in close(t, lanes, most):
                some[i] = some[j] = True
            yield pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[some]) for c in names], names)

    def decide(batches):
        for t in whole_groups(batches):
            group = t.column("group").to_numpy()
            for a, b in zip(cuts := runs(group), cuts[1:]):
                links = similar_links(t.slice(a, b - a), words, similarity, most)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in links], pa.int64()) for k in range(2)], ["a", "b"])

    dealt = known.select("s0", F.explode("keys").alias("key"))
    known = known.drop("keys")
    likely = components(bucket_links(dealt, ["key"], "s0", lanes, most, known.select("s0", "node", *lanes)))
    names = ["group", "side", "node", *digest, *lanes]
    met = block_pairs(known.join(likely, "node"), ["root"], "node", TEXTS).select(*names)
    met = stored(by_group(met).mapInArrow(open_ones, f"group long, side int, node long, s0 long, s1 long, {of}"), keep)
    met = met.join(texts.withColumnRenamed("doc_id", "node"), "node").select(*names, "text")
    roots = components(by_group(met).mapInArrow(decide, "a long, b long"))
    least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    named = known.join(roots.join(least, "root").select("node", "component_id"), "node", "left").select(*digest, F.coalesce("component_id", "node").alias("component_id"))
    out = stored(wide.join(named, digest, "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")))
    drop(docs.sparkSession, keep)
    return out


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each group of similar texts, the one with the least ``doc_id``; rows without ``doc_id`` stay.

    Of rows that repeat a ``doc_id`` one stays, the first by text.
    """
    found = similar_groups(docs.select("doc_id", "text"), words, similarity)
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias("__stay")).distinct()
    kept = docs.join(stay, F.col("doc_id") == F.col("__stay"), "left_semi")
    kept = kept.withColumn("__rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("__rank = 1").drop("__rank")
    return kept.unionByName(docs.where("doc_id IS NULL"))
