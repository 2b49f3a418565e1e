"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A match of the pattern is halved recursively down to single bytes, and two
neighbouring encodings are joined by re-encoding a window over their border,
widened by more and more tokens until both of its outer borders hold. A border
between tokens ``a b`` holds when the two alone encode to ``a, b``. A sequence in
which every border holds is the encoding of its bytes (merges go by rank, each
token is the merge of two of lower rank, so a first wrong merge would have to
cross some border, and would be made by that border's two tokens alone as well),
so the tokens outside of the window are final. Over a text the matches are
encoded separately, hence neighbours are joined as they are, level by level up a
tree. Decoding concatenates neighbours up a tree as well.

The reduction is the only encoder: no library encodes here. What a word encodes
to is remembered, as a join's windows are, in caches of bounded size.

Defined results: a null or empty text has no ids; lone surrogates cannot occur
in Spark strings; a null ``doc_id`` is carried along and repeated rows each get a
row; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of

#: White space to a tokeniser's regular expressions; this library's own also counts four separators.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Words that a worker remembers in each of two generations (a full one replaces the older), and their longest.
REMEMBERED, LONGEST = 200_000, 200
#: Bytes of a half that is remembered.
SHORT = 8
#: Texts that are encoded together, and neighbours that are concatenated at once.
BATCH, FAN = 16, 32


def same_blanks(pattern: str) -> str:
    """The pattern with its classes of white space spelt out."""
    return pattern.replace(r"[^\s", f"[^{BLANK}").replace(r"\S", f"[^{BLANK}]").replace(r"\s", f"[{BLANK}]")


def concatenated(parts: list[bytes]) -> bytes:
    """The parts joined level by level, ``FAN`` neighbours a node."""
    while len(parts) > FAN:
        parts = [b"".join(parts[k : k + FAN]) for k in range(0, len(parts), FAN)]
    return b"".join(parts)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [f"{i} " for i in range(len(self.tokens))]
        self.find = regex.compile(same_blanks(pattern)).findall
        self.plain = r" ?\p{L}+" in pattern
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.border = lru_cache(1 << 18)(self._border)
        self.short = lru_cache(1 << 18)(self._piece)
        self.seen = lru_cache(1 << 17)(self.window)
        self.joins = 0

    def window(self, data: bytes) -> list[int]:
        """The encoding of a window's bytes: the pair of least rank is merged, the leftmost first, until none is left."""
        ranks, n = self.ranks, len(data)
        at, after, before = [data[k : k + 1] for k in range(n)], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := ranks.get(data[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k]
            if not at[k] or j >= n or ranks.get(at[k] + at[j]) != r:
                continue  # one of the two has been merged since
            at[k] += at[j]
            at[j] = b""
            after[k] = then = after[j]
            if then < n:
                before[then] = k
                if (new := ranks.get(at[k] + at[then])) is not None:
                    heapq.heappush(heap, (new, k))
            if (first := before[k]) >= 0 and (new := ranks.get(at[first] + at[k])) is not None:
                heapq.heappush(heap, (new, first))
        return [ranks[t] for t in at if t]

    def _border(self, a: int, b: int) -> list[int]:
        return self.window(self.tokens[a] + self.tokens[b])

    def holds(self, a: int, b: int) -> bool:
        inner = self.border(a, b)
        return len(inner) == 2 and inner[0] == a

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both."""
        if not left or not right:
            return left + right
        self.joins += 1
        border = self.border
        inner = border(left[-1], right[0])
        if len(inner) == 2 and inner[0] == left[-1]:
            return left + right
        i, j, step = len(left) - 1, 1, 1
        while True:
            before = i == 0 or self.holds(left[i - 1], inner[0])
            after = j == len(right) or self.holds(inner[-1], right[j])
            if before and after:
                return left[:i] + inner + right[j:]
            i, j = i if before else max(0, i - step), j if after else min(len(right), j + step)
            step *= 2
            data = self.decode(left[i:]) + self.decode(right[:j])
            inner = self.seen(data) if len(data) <= 4 * SHORT else self.window(data)

    def _piece(self, data: bytes) -> list[int]:
        if len(data) == 1:
            return [self.ranks[data]]
        half = len(data) // 2
        return self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))

    def encode_piece(self, data: bytes) -> list[int]:
        return self.short(data) if len(data) <= SHORT else self._piece(data)

    def decode(self, ids: list[int]) -> bytes:
        return concatenated([self.tokens[k] for k in ids])

    def _word(self, word: str) -> bytes:
        if self.plain and word[:1] == " " and word[1:].isalpha():  # one match
            return array("I", self.encode_piece(word.encode())).tobytes()
        return concatenated([self._match(piece) for piece in self.find(word)])

    def _match(self, piece: str) -> bytes:
        """A match by itself, which a word may be as well."""
        if (ids := self.known.get(piece)) is None:
            ids = array("I", self.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
            if len(piece) <= LONGEST:
                self.known[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, unsigned 32-bit.

        A match never holds a space between two characters that are no white
        space except as its first character, so a text falls apart before such
        spaces and the parts are encoded, and remembered, by themselves.
        """
        known, older, words = self.known, self.older, words_of(text)
        out = list(map(known.get, words))
        if None in out:
            for k, w in enumerate(words):
                if out[k] is not None:
                    continue
                if (ids := known.get(w)) is None:  # it may be the second of its kind here
                    if (ids := older.get(w)) is None:
                        ids = self._word(w)
                    if len(w) <= LONGEST:
                        known[w] = ids
                out[k] = ids
        if len(known) >= REMEMBERED:
            self.older, self.known = known, {}
        return np.frombuffer(concatenated(out), np.uint32)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encode(t) for t in texts]


def _spelled() -> dict[str, int]:
    """The bytes by the characters that stand for them in a vocabulary's JSON file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(4)
def load(path: str, pattern: str, kind: type[Encoder] = Encoder) -> Encoder:
    """An encoder from a file of ranks, or from the JSON file of the same vocabulary."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        special, spelled = {t["content"] for t in found["added_tokens"]}, _spelled()
        ranks = {bytes(map(spelled.__getitem__, t)): i for t, i in found["model"]["vocab"].items() if t not in special}
    else:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return kind(ranks, pattern)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text.

    ``path`` is a file of ranks that every machine has, as the vocabulary's package puts it there.
    """

    def run(batches):
        own = load(path, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for at in range(0, b.num_rows, BATCH):
                for ids in own.encode_many([t or "" for t in b.column(1).slice(at, BATCH).to_pylist()]):
                    ids = ids.tolist()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256("".join(map(own.names.__getitem__, ids))[:-1].encode()).hexdigest())
                    text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of each text."""

    def run(batches):
        own = load(path, pattern)
        for b in batches:
            ids = [own.encode(t or "").astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary) of each row of (doc_id, ids)."""

    def run(batches):
        own = load(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")
