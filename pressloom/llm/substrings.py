"""Suffix-array dedup: every byte covered by a 100-byte string that starts earlier goes.

The texts are laid out once in chunks. Anchors (the least hash among the
24-grams of each 100-byte window) cut a text into segments of windows with one
anchor; a 100-byte string has its anchor at the same place wherever it occurs,
so its occurrences meet in the anchor's bucket. Hashes only say where strings
meet: what goes is decided by comparing bytes.

1. A chunk sends the anchors of its distinct segments, and learns which of them
   are found elsewhere as well.
2. It sends the segments of those as text. In a bucket they are sorted; of equal
   ones all but the earliest go whole. Where an anchor has several distinct
   segments, they are fed, in order, to a logarithmic index family
   (``Family``): each batch gets a suffix array of its windows, is merge-scanned
   against all levels for matches of the full length, and becomes a level
   itself; levels of like size merge, so a bucket costs O(n log n).
3. An anchor with very many distinct segments (the border of a passage that a
   share of all documents holds) is no single group: its windows are sent one by
   one, dealt out by a hash of each, and compared by the same family.

A chunk sends each distinct segment or window once, which combines hot passages
before the shuffle. Buckets hold some ``BUCKET`` bytes of text whatever the size
of the corpus; many of them share a partition, which is sorted by bucket and
read one bucket at a time. Marks return to their chunk, where they are united.
Order is (doc_id, start); a null ``doc_id`` counts as the smallest, and rows that
repeat a ``doc_id`` as different documents in the order of the layout.

Defined results: a null text is empty; texts under 100 bytes lose nothing; a
text repeated whole is removed whole; further columns stay as they are in
``without_repeats``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, runs, shared_dir, stored

LENGTH, GRAM = 100, 24
CHUNK, BLOCK = 1 << 20, 1 << 20
#: Distinct segments of one anchor beyond which its windows are dealt out one by one; the comparison is the same.
HOT = 2048
#: Windows in a batch of a family, windows beyond which a bucket's next family begins (between anchors), parts of a bucket; bytes of text for one bucket; most partitions.
BATCH, FAMILY, PARTS, BUCKET, PARTITIONS = 1 << 15, 1 << 17, 256, 16 << 20, 16384
_TABLE = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_LOW = np.uint64((1 << 24) - 1)
_LEAST = -(1 << 63)


def layout(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(chunk, n_bytes, data): the rows of ``docs``, all columns, some ``CHUNK`` bytes of text a row."""
    schema = docs.schema
    text_at = schema.fieldNames().index("text")

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        held, size, n = [], 0, 0
        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            begin = 0
            for k, x in enumerate(lengths.tolist(), 1):
                size += x
                if size >= CHUNK or k - begin >= 10_000:
                    yield chunk_row(first + n, held + [b.slice(begin, k - begin)], size)
                    held, size, begin, n = [], 0, k, n + 1
            if begin < b.num_rows:
                held.append(b.slice(begin))
        if held:
            yield chunk_row(first + n, held, size)

    path = f"{shared_dir(docs.sparkSession)}/pressloom-{xxhash.xxh64_hexdigest(np.random.bytes(16))}"
    docs.mapInArrow(run, "chunk long, n_bytes long, data binary").write.option("parquet.block.size", 8 << 20).option("compression", "none").parquet(path)
    keep.append(path)
    return docs.sparkSession.read.schema("chunk long, n_bytes long, data binary").parquet(path)


def chunk_row(chunk: int, held: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    table = table.take(pc.sort_indices(table, [("doc_id", "ascending")], null_placement="at_start"))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table.combine_chunks())
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "n_bytes", "data"])


def opened(data: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, their ids (nulls as the least number), the bytes of all texts, and the bounds of the texts in them."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    texts = pc.cast(pc.fill_null(table.column("text").combine_chunks(), ""), pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    ids = pc.fill_null(pc.cast(table.column("doc_id").combine_chunks(), pa.int64()), _LEAST).to_numpy(zero_copy_only=False)
    return table, ids, raw, bounds - bounds[0]


def segments(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor) of the runs of windows, inside the texts, with one anchor."""
    parts = []
    for at in range(0, max(0, len(raw) - LENGTH + 1), BLOCK):
        x = _TABLE[raw[at : at + BLOCK + LENGTH - 1]]
        h2 = x[:-1] * _ODD[0] + x[1:]
        h4 = h2[:-2] * _ODD[1] + h2[2:]
        h8 = h4[:-4] * _ODD[2] + h4[4:]
        h16 = h8[:-8] * _ODD[3] + h8[8:]
        h = h16[: len(x) - GRAM + 1] * _ODD[4] + h8[16 : len(x) - GRAM + 17]
        h ^= h >> np.uint64(32)
        h *= _ODD[5]
        h ^= h >> np.uint64(29)
        low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width, reach = LENGTH - GRAM + 1, 1
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        place = (low & _LOW).astype(np.int64)
        inside = np.ones(len(place), bool)
        for end in bounds[1:].tolist():
            if at < end < at + len(place) + LENGTH:
                inside[max(0, end - LENGTH + 1 - at) : max(0, end - at)] = False
        cuts = np.concatenate(([0], np.flatnonzero((place[1:] != place[:-1]) | (inside[1:] != inside[:-1])) + 1, [len(place)]))
        starts, sizes = cuts[:-1], np.diff(cuts)
        ok = inside[starts]
        parts.append((starts[ok] + at, sizes[ok], h[place[starts[ok]]]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(p) for p in zip(*parts))


def blob(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(arrays[0])], "<u8").tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unblob(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += out[-1].nbytes
    return [*out, raw[at:]]


SENT = "kind string, bucket int, chunk long, data binary"
#: Layouts: sent anchors; marks; segments to send as text, or window by window.
ANCHOR, MARK, ASK = ("<u8", "<u4", "<u1"), ("<u4", "<u4"), ("<u4", "<u1", "<u8")


def sent(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], ["kind", "bucket", "chunk", "data"])


def by_bucket(kind: str, chunk: int, key: np.ndarray, buckets: int, *arrays: np.ndarray):
    to = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(to[order])) + 1, [len(to)])) if len(to) else np.zeros(1, np.int64)
    for a, b in zip(cuts, cuts[1:]):
        own = order[a:b]
        yield kind, int(to[own[0]]), chunk, blob(*(x[own] for x in arrays))


def send_anchors(chunk: int, data: bytes, buckets: int) -> list[tuple]:
    """The anchor of each distinct segment of a chunk to its bucket; marks on segments that repeat inside of the chunk."""
    _, _, raw, bounds = opened(data)
    start, windows, anchor = segments(raw, bounds)
    if not len(start):
        return []
    whole = raw.tobytes()
    first: dict[bytes, int] = {}
    new = np.array([first.setdefault(whole[a:b], a) == a for a, b in zip(start.tolist(), (start + windows + LENGTH - 1).tolist())], bool)
    rows = [("M", 0, chunk, blob(start[~new].astype("<u4"), (windows[~new] + LENGTH - 1).astype("<u4")))] if not new.all() else []
    return rows + list(by_bucket("S", chunk, anchor[new], buckets, anchor[new], start[new].astype("<u4"), windows[new].astype("<u1")))


def by_chunk(kind: str, chunks: np.ndarray, *arrays: np.ndarray):
    order = np.argsort(chunks, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(chunks[order])) + 1, [len(order)])) if len(order) else np.zeros(1, np.int64)
    for a, b in zip(cuts, cuts[1:]):
        own = order[a:b]
        yield kind, 0, int(chunks[own[0]]), blob(*(x[own] for x in arrays))


def gathered(rows: list[tuple], kinds: tuple[str, ...]) -> list[np.ndarray]:
    """All entries of the blobs, with their chunks in front."""
    parts = [unblob(data, *kinds)[:-1] for _, data in rows]
    chunks = np.repeat(np.array([c for c, _ in rows], np.int64), [len(p[0]) for p in parts])
    return [chunks, *(np.concatenate([p[k] for p in parts]) for k in range(len(kinds)))]


def resolve_anchors(rows: list[tuple]) -> list[tuple]:
    """Which segments share their anchor, so that they must be compared as text (A) or window by window (W)."""
    chunk, anchor, start, windows = gathered(rows, ANCHOR)
    _, which, many = np.unique(anchor, return_inverse=True, return_counts=True)
    many, out = many[which], []
    for kind, own in (("A", (many > 1) & (many <= HOT)), ("W", many > HOT)):
        if own.any():
            out += by_chunk(kind, chunk[own], start[own], windows[own], anchor[own])
    return out


def send_texts(chunk: int, data: bytes, asked: list[tuple[str, bytes]], buckets: int) -> list[tuple]:
    """The text of the segments asked for, by the bucket of their anchor, or of their windows, by a hash of each."""
    _, ids, raw, bounds = opened(data)
    rows, whole = [], raw.tobytes()
    for kind in "AW":
        parts = [unblob(d, *ASK)[:-1] for k, d in asked if k == kind]
        if not parts:
            continue
        start, windows, route = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.argsort(start, kind="stable")
        start, windows, route = start[order].astype(np.int64), windows[order].astype(np.int64), route[order]
        if kind == "W":
            start = np.repeat(start - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
            first: dict[bytes, int] = {}
            new = np.array([first.setdefault(whole[a : a + LENGTH], a) == a for a in start.tolist()], bool)
            if not new.all():
                rows.append(("M", 0, chunk, blob(start[~new].astype("<u4"), np.full((~new).sum(), LENGTH, "<u4"))))
            start = start[new]
            windows, route = np.ones(len(start), np.int64), np.array([xxhash.xxh3_64_intdigest(whole[a : a + LENGTH]) for a in start.tolist()], np.uint64)
        doc = ids[np.searchsorted(bounds, start, "right") - 1]
        to = (route % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        for a, b in zip(cuts := runs(to[order]), cuts[1:]):
            own = order[a:b]
            part = (route[own] >> np.uint64(40)) % np.uint64(PARTS)
            head = np.array([len(own)], "<u8").tobytes() + b"".join(x.tobytes() for x in (start[own].astype("<u4"), windows[own].astype("<u1"), doc[own].astype("<i8"), part.astype("<u1")))
            text = b"".join([whole[x:y] for x, y in zip(start[own].tolist(), (start[own] + windows[own] + LENGTH - 1).tolist())])
            rows.append(("T", int(to[own[0]]), chunk, zstandard.ZstdCompressor(level=1).compress(head + text)))
    return rows


class Family:
    """A logarithmic family of suffix arrays over windows of ``LENGTH`` bytes.

    A level is the array of its distinct windows in order. ``add`` sorts a batch
    (its suffix array, to the length sought), scans it together with every level
    as two sorted runs are merged, and tells which windows no level and no
    earlier place in the batch holds; those become a level, and levels no larger
    than the newest merge into it, so there are logarithmically many.
    """

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, windows: np.ndarray) -> np.ndarray:
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        first = np.ones(len(ranked), bool)
        first[1:] = ranked[1:] != ranked[:-1]
        for level in self.levels:
            first &= ~scanned(level, ranked)
        new = np.zeros(len(windows), bool)
        new[order] = first
        level = ranked[first]
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            level = np.concatenate((self.levels.pop(), level))
            level.sort(kind="stable")  # two runs: a merge
        if len(level):
            self.levels.append(level)
        return new


def scanned(level: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Which of the sorted windows a level holds: one pass over both, merged."""
    both = np.concatenate((level, ranked))
    order = np.argsort(both, kind="stable")  # two runs; of equal windows the level's comes first
    merged = both[order]
    head = np.ones(len(merged), bool)
    head[1:] = merged[1:] != merged[:-1]
    held = (order < len(level))[np.flatnonzero(head)][np.cumsum(head) - 1]
    out = np.zeros(len(both), bool)
    out[order] = held
    return out[len(level) :]


def windows_of(text: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All windows of the segments (concatenated, of so many windows each), in order."""
    ends = np.cumsum(sizes + LENGTH - 1)
    begins = np.repeat(ends - sizes - LENGTH + 1 - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return np.lib.stride_tricks.sliding_window_view(text, LENGTH)[begins].copy().view(f"S{LENGTH}").ravel()


def resolve_texts(texts: list[tuple]) -> list[tuple]:
    """Marks on what is seen earlier: equal segments whole, then windows of segments that differ."""
    parts = [unblob(data, "<u4", "<u1", "<i8", "<u1") for _, data in texts]
    chunk = np.repeat(np.array([c for c, _ in texts], np.int64), [len(p[0]) for p in parts])
    start, sizes, doc, part = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(4))
    raw = b"".join(p[4] for p in parts)
    ends = np.cumsum(sizes + LENGTH - 1)
    begin = ends - sizes - LENGTH + 1
    order = np.lexsort((start, chunk, doc, part))
    first: dict[bytes, int] = {}
    new = np.array([first.setdefault(raw[a:b], k) == k for k, a, b in zip(order.tolist(), begin[order].tolist(), ends[order].tolist())], bool)
    old = order[~new]
    out = list(by_chunk("M", chunk[old], start[old].astype("<u4"), (sizes[old] + LENGTH - 1).astype("<u4"))) if len(old) else []
    order, raw = order[new], np.frombuffer(raw, np.uint8)
    for own in families(order, part, sizes):
        if len(own) > 1:
            where, at, n = old_runs(own, sizes, repeated(own, begin, sizes, raw))
            out += by_chunk("M", chunk[where], (start[where] + at).astype("<u4"), (n + LENGTH - 1).astype("<u4"))
    return out


def families(order: np.ndarray, part: np.ndarray, sizes: np.ndarray):
    """The segments in order, cut where a part ends and ``FAMILY`` windows are full: segments of one anchor stay together."""
    ends = np.append(np.flatnonzero(np.diff(part[order])) + 1, len(order))
    windows = np.cumsum(sizes[order])
    at = 0
    for end in ends.tolist():
        if windows[end - 1] - (windows[at - 1] if at else 0) >= FAMILY or end == len(order):
            yield order[at:end]
            at = end


def repeated(own: np.ndarray, begin: np.ndarray, sizes: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Which windows of the segments, in order, are seen earlier; a batch at a time through one family."""
    family, out = Family(), []
    cuts = np.searchsorted(np.cumsum(sizes[own]), np.arange(BATCH, sizes[own].sum() + BATCH, BATCH)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
        some = own[a:b]
        if len(some):
            text = np.concatenate([raw[x : x + n + LENGTH - 1] for x, n in zip(begin[some].tolist(), sizes[some].tolist())])
            out.append(~family.add(windows_of(text, sizes[some])))
    return np.concatenate(out)


def old_runs(own: np.ndarray, sizes: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first window, windows) of the runs of old windows inside a segment."""
    firsts = np.cumsum(sizes[own]) - sizes[own]
    opens = old.copy()
    opens[1:] &= ~old[:-1]
    opens[firsts] = old[firsts]
    starts = np.flatnonzero(opens)
    ends = old.copy()
    ends[:-1] &= ~old[1:] | opens[1:]
    segment = np.searchsorted(firsts, starts, "right") - 1
    return own[segment], starts - firsts[segment], np.flatnonzero(ends) - starts + 1


def exchanged(send: DataFrame, buckets: int, resolve, kind: str) -> DataFrame:
    """Deal what the chunks send to their buckets, resolve there, a bucket at a time; marks pass through."""

    def run(batches):
        held: list[tuple] = []
        at = None
        for b in batches:
            passed = []
            for own, bucket, chunk, data in zip(*(c.to_pylist() for c in b.columns)):
                if own != kind:
                    passed.append((own, bucket, chunk, data))
                    continue
                if bucket != at and held:
                    yield sent(resolve(held))
                    held = []
                held.append((chunk, data))
                at = bucket
            if passed:
                yield sent(passed)
        if held:
            yield sent(resolve(held))

    n = min(buckets, PARTITIONS)
    to = F.when(F.col("kind") == kind, F.col("bucket") % n).otherwise(F.pmod(F.xxhash64("chunk"), F.lit(n))).cast("int")
    return send.repartitionById(n, to).sortWithinPartitions("kind", "bucket").mapInArrow(run, SENT)


def marked(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(data, marks): the chunks of ``docs`` and the marks on each."""
    chunks = layout(docs, keep)
    size = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first().n
    buckets = max(8, -(-size // BUCKET))

    def first(batches):
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1)):
                yield sent(send_anchors(chunk, data.as_buffer(), buckets))

    def second(batches):
        for b in batches:
            for chunk, data, asked in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                yield sent(send_texts(chunk, data.as_buffer(), [(x["kind"], x["data"]) for x in asked.as_py()], buckets))

    one = stored(exchanged(chunks.select("chunk", "data").mapInArrow(first, SENT), buckets, resolve_anchors, "S"), keep)
    asked = one.where("kind IN ('A', 'W')").groupBy("chunk").agg(F.collect_list(F.struct("kind", "data")).alias("asked"))
    two = chunks.select("chunk", "data").join(asked, "chunk").mapInArrow(second, SENT)
    two = stored(exchanged(two, buckets, resolve_texts, "T"), keep)
    marks = one.where("kind = 'M'").unionByName(two.where("kind = 'M'")).groupBy("chunk").agg(F.collect_list("data").alias("marks"))
    return chunks.select("chunk", "data").join(marks, "chunk", "left").select("data", "marks")


def removed(raw: np.ndarray, marks: list[bytes] | None) -> np.ndarray:
    parts = [unblob(data, *MARK) for data in marks or []]
    if not parts:
        return np.zeros(len(raw), bool)
    start, length = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(2))
    steps = np.bincount(start, minlength=len(raw) + 1) - np.bincount(start + length, minlength=len(raw) + 1)
    return np.cumsum(steps[:-1]) > 0


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    keep: list[str] = []

    def run(batches):
        for b in batches:
            for data, marks in zip(b.column(0), b.column(1)):
                table, _, raw, bounds = opened(data.as_buffer())
                gone = removed(raw, marks.as_py())
                out: list[list] = [[], [], [], []]
                for x, y in zip(bounds.tolist(), bounds[1:].tolist()):
                    g = gone[x:y]
                    out[0].append(y - x)
                    out[1].append(int(g.sum()))
                    out[2].append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
                    out[3].append(hashlib.sha256(raw[x:y][~g].tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays([pc.cast(table.column("doc_id").combine_chunks(), pa.int64()), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = stored(marked(slim, keep).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    drop(docs.sparkSession, keep)
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the repeated bytes; ``n_chars``, if there, brought up to date.

    A character cut in part is dropped.
    """
    keep: list[str] = []
    names = docs.columns

    def run(batches):
        for b in batches:
            for data, marks in zip(b.column(0), b.column(1)):
                table, _, raw, bounds = opened(data.as_buffer())
                gone = removed(raw, marks.as_py())
                if gone.any():
                    old = table.column("text").to_pylist()
                    texts = [None if t is None else raw[x:y][~gone[x:y]].tobytes().decode("utf-8", "ignore") for t, x, y in zip(old, bounds.tolist(), bounds[1:].tolist())]
                    table = table.set_column(names.index("text"), table.schema.field("text"), pa.array(texts, table.schema.field("text").type))
                    if "n_chars" in names:
                        at = names.index("n_chars")
                        counts = [n if t is None else len(t) for n, t in zip(table.column("n_chars").to_pylist(), texts)]
                        table = table.set_column(at, table.schema.field("n_chars"), pa.array(counts, table.schema.field("n_chars").type))
                yield from table.to_batches()

    out = stored(marked(docs, keep).mapInArrow(run, docs.schema))
    drop(docs.sparkSession, keep)
    return out
