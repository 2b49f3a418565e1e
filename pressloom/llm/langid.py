"""Language identification by segmentation-marginalised unigrams.

The vocabulary of pieces is a fixed public one. Each language has a probability
for every piece; a word's probability is the sum over all its segmentations
into pieces, by the forward algorithm. The probabilities are learned by
expectation maximisation (forward and backward) from word counts of a sample:
at most about ``SAMPLE`` texts of each language, picked by a hash. Words are the
maximal runs of letters, lower-cased, with the vocabulary's mark for a space in
front; a run of over ``LONGEST`` letters is taken in parts of that many.

A text's score is the posterior probability of its best language under equal
priors. Defined results: a null text or one without a letter is ``und`` with
score 0, as is every text if there is nothing to learn from; ties go to the
first language by name; a null ``doc_id`` is not held out; repeated rows each
get a row; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, ROUNDS, LONGEST, UNKNOWN, SMOOTH = 400, 3, 30, 1e-7, 0.1
REMEMBERED, BATCH, BLOCK = 300_000, 64, 8192
_LETTERS = regex.compile(r"\p{L}+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_in(text: str) -> list[str]:
    found = _LETTERS(text.lower())
    if any(len(w) > LONGEST for w in found):
        found = [w[k : k + LONGEST] for w in found for k in range(0, len(w), LONGEST)]
    return found


class Pieces:
    """A vocabulary that looks up all substrings of many words of one length at once."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [p for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for p in [sp.id_to_piece(i)]]
        own = sorted({p.lower() for p in own})
        self.size, self.longest = len(own), max(map(len, own))
        hashes = np.array([self.hash_of(p) for p in own], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int32)

    @staticmethod
    def hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def substrings(self, codes: np.ndarray):
        """(begin, end, rows, ids) of the pieces at each place of the words (one a row of code points)."""
        n = codes.shape[1]
        for i in range(n):
            h = np.zeros(len(codes), np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * _BASE + codes[:, j - 1] + np.uint64(1)
                at = np.minimum(np.searchsorted(self.hashes, h), self.size - 1)
                rows = np.flatnonzero(self.hashes[at] == h)
                if len(rows) or j == i + 1:
                    yield i, j, rows, self.ids[at[rows]]


def by_length(words: list[str]):
    """(indexes, code points with the space mark in front) of the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths).tolist():
        where = np.flatnonzero(lengths == n)
        for at in range(0, len(where), BLOCK):
            part = where[at : at + BLOCK]
            text = "".join("▁" + words[k] for k in part)
            yield part, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n + 1).astype(np.uint64)


def log_probabilities(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log probability of each word (rows) in each language, over all segmentations. ``table``: pieces x languages."""
    out = np.zeros((len(words), table.shape[1]))
    for part, codes in by_length(words):
        a = np.zeros((codes.shape[1] + 1, len(codes), table.shape[1]))
        a[0] = 1
        for i, j, rows, ids in pieces.substrings(codes):
            if j == i + 1 and len(rows) < len(codes):
                strange = np.ones(len(codes), bool)
                strange[rows] = False
                a[j][strange] += a[i][strange] * UNKNOWN
            if len(rows) == len(codes):
                a[j] += a[i] * table[ids]
            elif len(rows):
                a[j][rows] += a[i][rows] * table[ids]
        out[part] = np.log(a[-1])
    return out


def learn(words: list[str], counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """The piece probabilities of one language by expectation maximisation."""
    p = np.full(pieces.size, 1 / pieces.size)
    found = [(part, codes.shape, list(pieces.substrings(codes))) for part, codes in by_length(words)]
    for _ in range(ROUNDS):
        expected = np.zeros(pieces.size)
        for part, (n, width), spans in found:
            a, b = np.zeros((width + 1, n)), np.zeros((width + 1, n))
            a[0], b[width] = 1, 1
            for i, j, rows, ids in spans:
                if j == i + 1:
                    a[j] += a[i] * UNKNOWN
                a[j][rows] += a[i][rows] * p[ids]
            for i, j, rows, ids in reversed(spans):
                if j == i + 1:
                    b[i] += b[j] * UNKNOWN
                b[i][rows] += b[j][rows] * p[ids]
            weight = counts[part] / a[width]
            for i, j, rows, ids in spans:
                expected += np.bincount(ids, a[i][rows] * p[ids] * b[j][rows] * weight[rows], pieces.size)
        p = (expected + SMOOTH) / (expected.sum() + SMOOTH * pieces.size)
    return p


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


class Model:
    """Languages by name, and piece probabilities for each; small, so it travels in the task's closure."""

    def __init__(self, languages: list[str], table: np.ndarray, path: str):
        self.languages, self.table, self.path = languages, table, path

    @classmethod
    def fit(cls, docs: DataFrame, path: str, sample: int = SAMPLE) -> Model:
        """From text and language of the rows given. Bounded: some ``sample`` texts of a language."""
        labelled = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h")).where("lang IS NOT NULL")
        sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
        languages = sorted(sizes)
        if not languages:
            return cls([], np.zeros((0, 0)), path)
        share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / sizes[k]))])
        picked = labelled.where((F.pmod("h", F.lit(1 << 30)) / (1 << 30)) < share[F.col("lang")]).select("lang", "text")

        def count(batches):
            for b in batches:
                tally: dict[tuple[str, str], int] = {}
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for w in words_in(text or ""):
                        tally[lang, w] = tally.get((lang, w), 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.string()), pa.array(list(tally.values()), pa.int64())], ["lang", "word", "n"])

        counts = picked.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
        pieces = Pieces(path)
        lang, words, n = np.array(counts.column(0).to_pylist(), object), counts.column(1).to_pylist(), counts.column(2).to_numpy().astype(float)
        table = np.zeros((pieces.size, len(languages)))
        for k, name in enumerate(languages):
            own = np.flatnonzero(lang == name)
            table[:, k] = learn([words[i] for i in own], n[own], pieces)
        return cls(languages, table, path)

    def predict(self, texts: list[str | None], memory: dict) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``memory`` keeps the words between calls."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        if "pieces" not in memory:
            memory |= {"pieces": Pieces(self.path), "known": {}, "rows": np.zeros((0, len(self.languages)), np.float32)}
        out, scores = [], np.zeros(len(texts))
        for at in range(0, len(texts), BATCH):
            split = [words_in(t or "") for t in texts[at : at + BATCH]]
            known = memory["known"]
            if len(known) > REMEMBERED:
                known.clear()
                memory["rows"] = memory["rows"][:0]
            if new := list(set().union(*split).difference(known)):
                start = len(known)
                known.update((w, start + k) for k, w in enumerate(new))
                if len(known) > len(memory["rows"]):
                    grown = np.zeros((max(1024, 2 * len(known)), len(self.languages)), np.float32)
                    grown[:start] = memory["rows"][:start]
                    memory["rows"] = grown
                memory["rows"][start : start + len(new)] = log_probabilities(new, memory["pieces"], self.table)
            for k, words in enumerate(split, at):
                if not words:
                    out.append("und")
                    continue
                total = memory["rows"][np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0, dtype=np.float64)
                best = int(total.argmax())
                scores[k] = 1 / np.exp(total - total[best]).sum()
                out.append(self.languages[best])
        return out, scores


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row."""

    def run(batches):
        memory: dict = {}
        for b in batches:
            langs, scores = model.predict(b.column(2).to_pylist(), memory)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is found with at least that score."""

    def run(batches):
        memory: dict = {}
        for b in batches:
            langs, scores = model.predict(b.column(b.schema.get_field_index("text")).to_pylist(), memory)
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
