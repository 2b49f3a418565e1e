"""Best-fit packing of tokenised texts by pattern packing.

A text's ids and a separator are one piece, or, where they exceed a sequence,
pieces of a whole sequence each after a first one that may be shorter. The
histogram of lengths (at most ``size`` numbers, whatever the corpus) is all the
driver gets. Patterns of two, three and four lengths that fill a sequence
exactly are enumerated, their repeat counts fitted to the histogram by
non-negative least squares and rounded down to what the histogram holds; what
is left over is packed best-fit decreasing, by runs of equal lengths. Where
best-fit decreasing alone needs fewer sequences, that plan is taken. A plan is
a list of runs for each length; a piece finds its place by its rank among the
pieces of its length. Ranks are counted within ``SALTS`` parts of each length, so
a length that a third of all pieces have is no single task.

Defined results: a null or empty text is the separator alone; a null ``doc_id``
is carried along; repeated rows are packed each; further columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder, load
from .common import stored

SIZE, SEPARATOR = 2048, 0
#: What the byte-level pre-tokeniser of ``tokenizers`` splits by.
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Patterns of three and four lengths that are tried for each largest length; rounds of the fit.
TRIED, ROUNDS = 24, 300
#: Parts in which the pieces of a length are ranked, whatever their number.
SALTS = 512


class Merges(Encoder):
    """The same encoder with a library's merge loop in place of the tree: here tokens are input, not the operator."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__(ranks, pattern)
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _word(self, word: str) -> bytes:
        return array("I", self.core.encode_ordinary(word)).tobytes()


@lru_cache(4)
def added_tokens(path: str) -> dict[str, int]:
    """The ids of the tokens that the vocabulary's JSON file adds, which the library finds in a text before anything else."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    assert not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in found)
    return {t["content"]: t["id"] for t in found}


def encoded(texts: list[str], path: str) -> list[np.ndarray]:
    """The ids of each text as the ``tokenizers`` library gives them: added tokens first, the parts between by themselves."""
    own, added = load(path, GPT2, Merges), added_tokens(path)
    if not any(t in text for text in texts for t in added):
        return own.encode_many(texts)
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split
    parts = [cut(text) for text in texts]
    between = iter(own.encode_many([p for row in parts for p in row[::2]]))
    return [np.concatenate([np.array([added[p]], "<u4") if k % 2 else next(between) for k, p in enumerate(row)]) for row in parts]


def pieces(docs: DataFrame, path: str, size: int = SIZE, batch: int = 16) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece; ``path`` is the vocabulary's JSON file.

    The ids are those of the ``tokenizers`` library, from the same merges and words remembered, added tokens included.
    """

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                for doc_id, ids in zip(part.column(0).to_pylist(), encoded([t or "" for t in part.column(1).to_pylist()], path)):
                    ids = np.append(ids, np.uint32(SEPARATOR)).astype("<u4")
                    cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        for column, value in zip(out, (doc_id, k, x, y - x, zlib.crc32(ids[x:y].tobytes()))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(out)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(have: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over {length: count}: a list of (lengths, sequences)."""
    free: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    spaces = np.zeros(size + 1, bool)
    for length in sorted((k for k, n in have.items() if n), reverse=True):
        left = have[length]
        while left:
            at = int(spaces[length:].argmax()) + length
            if not spaces[at]:
                each = size // length
                done: list[tuple[tuple[int, ...], int]] = [((length,) * each, left // each), ((length,) * (left % each), 1)]
                for lengths, n in done:
                    if n and lengths:
                        room = size - length * len(lengths)
                        free[room][lengths] = free[room].get(lengths, 0) + n
                        spaces[room] = True
                left = 0
                continue
            lengths, n = free[at].popitem()
            used = min(left, n)
            if n > used:
                free[at][lengths] = n - used
            spaces[at] = bool(free[at])
            free[at - length][(*lengths, length)] = free[at - length].get((*lengths, length), 0) + used
            spaces[at - length] = True
            left -= used
    return [(lengths, n) for group in free.values() for lengths, n in group.items()]


def patterns(have: dict[int, int], size: int = SIZE) -> list[tuple[int, ...]]:
    """Pairs that fill a sequence, and for each length some threes and fours, over the lengths at hand."""
    there = np.array(sorted(k for k, n in have.items() if n and k < size), np.int64)
    known, found = set(there.tolist()), set()
    by_count = sorted(known, key=lambda k: (-have[k], k))
    for a in known:
        if size - a in known:
            found.add(tuple(sorted((a, size - a))))
        rest = size - a
        tried = 0
        for b in by_count:
            if b < rest and rest - b in known:
                found.add(tuple(sorted((a, b, rest - b))))
                tried += 1
                if tried >= TRIED:
                    break
        tried = 0
        for b in by_count[: TRIED * 4]:
            half = (rest - b) // 2
            if half > 0 and rest - b - half in known and half in known:
                found.add(tuple(sorted((a, b, half, rest - b - half))))
                tried += 1
                if tried >= TRIED // 4:
                    break
    return sorted(found)


def fitted(have: dict[int, int], found: list[tuple[int, ...]], size: int = SIZE) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths in the patterns near the histogram: projected gradient with momentum."""
    at = np.array([(k, length) for k, p in enumerate(found) for length in p], np.int64)
    goal = np.zeros(size + 1)
    for length, n in have.items():
        goal[length] = n
    rows, cols, k = at[:, 1], at[:, 0], len(found)
    x = y = np.zeros(k)
    # a bound of the largest singular value, by the largest column and row sums
    step = 1 / (np.bincount(cols, minlength=k).max() * np.bincount(rows, minlength=size + 1).max())
    t = 1.0
    for _ in range(ROUNDS):
        miss = np.bincount(rows, y[cols], size + 1) - goal
        new = np.maximum(0, y - step * np.bincount(cols, miss[rows], k))
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / u * (new - x), u
    return x


def plan(have: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, sequences) for the whole histogram."""
    full = [((size,), have[size])] if have.get(size) else []
    left = {k: n for k, n in have.items() if n and k < size}
    alone = best_fit(left, size)
    out = []
    if found := patterns(left, size):
        x = fitted(left, found, size)
        for k in np.argsort(-x, kind="stable").tolist():
            if x[k] < 0.5:
                break
            need = {length: found[k].count(length) for length in set(found[k])}
            n = min(round(float(x[k])), *(left[length] // m for length, m in need.items()))
            if n:
                out.append((found[k], n))
                for length, m in need.items():
                    left[length] -= n * m
    out += best_fit(left, size)
    return full + min(out, alone, key=lambda p: sum(n for _, n in p))


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds (sequence_id, offset) to pieces with a ``length`` from 1 to ``size``."""
    have = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequences = 0
    for lengths, n in plan(have, size):
        offset = 0
        for length in lengths:
            runs[length].append((taken[length], sequences, offset))
            taken[length] += n
            offset += length
        sequences += n
    assert all(taken[k] == n for k, n in have.items())
    tables = {k: np.array(v, np.int64) for k, v in runs.items()}

    def place(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length).tolist():
                where = np.flatnonzero(length == k)
                t = tables[k]
                row = t[np.searchsorted(t[:, 0], rank[where], "right") - 1]
                sequence[where], offset[where] = row[:, 1] + rank[where] - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(len(names))] + [pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = cut.columns
    salted = cut.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)))
    counts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("length", "__salt", (F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")).alias("__before"))
    order = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(before, ["length", "__salt"]).withColumn("__rank", F.row_number().over(order) - 1 + F.col("__before"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.select(*names, "__rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def packed(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """The pieces of all texts with their places."""
    return pack(stored(pieces(docs, path, size)), size)
