"""Lexicons: nested groups of terms, compiled on the driver to regular expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from importlib import resources

# The roots that groups hang on, and the least score of each label.
ROOTS = frozenset(
    "accident_or_disaster_terms aggressor_terms digital_or_cyber_violence_terms direct_terms female_reference_terms help_and_prevention_terms indirect_terms prior_violence_or_control_terms relationship_terms sexual_violence_terms structural_context_terms violence_types_and_modalities".split()
)
THRESHOLDS = {"strong_candidate": 8, "weak_candidate": 5, "review_candidate": 3}


def plain(term: str) -> str:
    """The same normal form as ``text.normalize`` gives a column."""
    letters = "".join(c for c in unicodedata.normalize("NFD", term) if unicodedata.category(c) != "Mn")
    return " ".join(letters.lower().split())


def flatten(tree: dict, prefix: str = "") -> dict[str, list[str]]:
    """Group path -> terms; of terms with one normal form the first spelling stays."""
    out: dict[str, list[str]] = {}
    for name, below in tree.items():
        path = f"{prefix}.{name}" if prefix else str(name)
        if not prefix and name not in ROOTS:
            continue
        if isinstance(below, dict):
            out |= flatten(below, path)
        elif isinstance(below, list):
            terms: dict[str, str] = {}
            for t in below:
                if plain(str(t)):
                    terms.setdefault(plain(str(t)), str(t))
            out[path] = list(terms.values())
    return out


def deep_merge(a: dict, b: dict) -> dict:
    """Both trees; where they meet in something other than two trees, ``b``'s."""
    return a | {k: deep_merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}


def pattern_of(term: str) -> str:
    """A regular expression (Java, Unicode classes) for one term between word borders."""
    return r"(?<!\w)" + r"\s+".join(_escaped(w) for w in plain(term).split(" ")) + r"(?!\w)"


def _escaped(word: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", word)


def alternation(terms: Iterable[str]) -> str:
    return r"(?U)(?<!\w)(?:" + "|".join(r"\s+".join(_escaped(w) for w in plain(t).split(" ")) for t in sorted(terms, key=lambda t: (-len(t), t))) + r")(?!\w)"


@dataclass(frozen=True)
class Lexicon:
    groups: dict[str, tuple[str, ...]]
    thresholds: dict[str, int]

    @classmethod
    def from_tree(cls, *trees: dict) -> Lexicon:
        merged: dict = {}
        for t in trees:
            merged = deep_merge(merged, t)
        return cls({k: tuple(v) for k, v in flatten(merged).items()}, THRESHOLDS | {k: int(v) for k, v in (merged.get("thresholds") or {}).items()})

    @classmethod
    def from_yaml(cls, *paths: str) -> Lexicon:
        import yaml

        return cls.from_tree(*(yaml.safe_load(open(p, encoding="utf-8")) or {} for p in paths))

    @classmethod
    def default(cls) -> Lexicon:
        """A small built-in example in Spanish; a deployment passes its own YAML files."""
        groups = {}
        for line in resources.files("pressloom").joinpath("data/lexicon.txt").read_text("utf-8").splitlines():
            if line and not line.startswith("#"):
                path, terms = line.split(" = ", 1)
                groups[path] = tuple(terms.split(" ; "))
        return cls(groups, dict(THRESHOLDS))

    def under(self, *prefixes: str) -> list[str]:
        """The groups equal to or below a prefix."""
        return [g for g in self.groups if any(g == p or g.startswith(p + ".") for p in prefixes)]

    def terms(self, *prefixes: str) -> list[str]:
        return [t for g in self.under(*prefixes) for t in self.groups[g]]

    def regex(self, *prefixes: str) -> str | None:
        """One expression for all terms below the prefixes; None without terms."""
        terms = self.terms(*prefixes)
        return alternation(set(terms)) if terms else None

    def rows(self) -> list[tuple[str, str, str, str]]:
        """(group_path, term, term_norm, regex) of each term."""
        return [(g, t, plain(t), pattern_of(t)) for g, terms in self.groups.items() for t in terms]
