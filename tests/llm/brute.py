"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(nodes, links):
    """{node: least node of its component}."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text, words=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = WORD.findall(low)
    if not found:
        return 0
    shingles = [" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def without_repeats(docs, length=100):
    """{doc_id: (bytes, removed, spans, sha256 of the rest)} of (doc_id, text), in the order of doc_id."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = [False] * len(data)
        for k in range(len(data) - length + 1):
            piece = data[k : k + length]
            if piece in seen:
                gone[k : k + length] = [True] * length
            seen.add(piece)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        rest = bytes(c for c, g in zip(data, gone) if not g)
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    many = {w for w in windows if windows.count(w) > 1}
    covered = {k + i for k, w in enumerate(windows) if w in many for i in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
