"""Quality rules as a bitmask ledger.

``measure`` reads each whole text once and keeps its measurements. ``ledger``
evaluates every rule once and stores the failures as bits. Policies are named
versions of a mask over those bits, so a verdict, another policy's verdict and
the effect of leaving a rule out (``ablations``) are bitwise operations and
counts over the ledger; the texts are not read again.

Defined results: a null or empty text has no words and fails the base rules; a
null ``doc_id`` is carried along; repeated rows each get a row; further columns
are ignored by the ledger; an empty table gives an empty ledger.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES, SYMBOLS, WINDOW = " \t\n\x0b\x0c\r", "#*$%&|<>", 5
_SYMBOLS, _SPACES = re.compile(f"[{re.escape(SYMBOLS)}]+"), re.compile(f"[{SPACES}]+")
MEASURED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # a condition over the measurements


RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
)
BASE = ("few_words", "repeated_words")
#: Published versions stay as they are; a change is a new version.
POLICIES = {"base": BASE, "v1": tuple(r.name for r in RULES)}


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[k:] for k in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    ids: dict[tuple, int] = {}
    which = np.array([ids.setdefault(w, len(ids)) for w in windows])
    starts = np.flatnonzero(np.bincount(which)[which] > 1)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return int((np.cumsum(steps) > 0).sum())


def measurements(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeat_words(words)


def measure(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = np.array([measurements(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(MEASURED))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in rows.T)], ["doc_id", *MEASURED])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURED))


def mask(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    return sum(1 << k for k, r in enumerate(rules) if r.name in POLICIES[policy])


def fail_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(rules)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements of each row and ``fail_bits``."""
    return measure(docs).withColumn("fail_bits", fail_bits(rules))


def passes(policy: str, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules))) == 0


def ablations(held: DataFrame, policy: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rule, failed, failed_alone): what each rule of a policy rejects, and what would be kept without it."""
    of = F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)))
    sums = held.agg(*[e for k, r in enumerate(rules) if r.name in POLICIES[policy] for e in (F.count_if(of.bitwiseAND(F.lit(1 << k)) != 0).alias(f"a{k}"), F.count_if(of == (1 << k)).alias(f"b{k}"))])
    rows = ", ".join(f"'{r.name}', a{k}, b{k}" for k, r in enumerate(rules) if r.name in POLICIES[policy])
    return sums.select(F.expr(f"stack({len(POLICIES[policy])}, {rows}) AS (rule, failed, failed_alone)"))


def verdicts(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    return ledger(docs).withColumns({"base_failed": ~passes("base"), "kept": passes("base") & passes(policy)})
