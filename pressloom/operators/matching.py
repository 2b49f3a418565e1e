"""Lexicon matching in texts and sentence windows.

A normalized text is padded: every run of what is no letter of a word stands
between spaces, so a term is there at word borders where its words are between
spaces. Which terms a text has is asked by the first words of the terms, all at
once; a window is only asked for the terms of its article, and a text without
terms has no windows at all. Each sentence is normalized and padded once; its
windows are put together from it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.lexicon import Lexicon, pattern_of, plain
from ..functions.text import let

WINDOWS = "array<struct<window_id:int,window_text:string,head:string,terms:array<string>,groups:array<string>>>"
TERMS = "array<struct<key:string,value:array<string>>>"
#: What is neither in a word nor the space; the first 128 characters as one table.
NO_WORD = "(?U)[" + "".join(f"\\x{k:02x}" for k in range(128) if not re.match("[A-Za-z0-9_ ]", chr(k))) + r"[\x{80}-\x{10ffff}&&[^\w]]]+"
HEAD = 500


def strings(values: Iterable[str]) -> Column:
    """A constant array; one literal for the optimizer to fold, however many values."""
    joined = "\x1f".join(values)
    return F.split(F.lit(joined), "\x1f") if joined else F.array().cast("array<string>")


def lookup(table: dict[str, list[str]]) -> Column:
    """A constant map of the keys to their values between unit separators; one literal."""
    return F.str_to_map(F.lit("\x1e".join(f"{k}\x1d{chr(31).join(v)}" for k, v in table.items())), F.lit("\x1e"), F.lit("\x1d"))


def mark(term: str) -> str:
    """A term as it stands in a padded text."""
    return f" {plain(term)} "


def padded(normalized: Column) -> Column:
    """A normalized text with spaces around all that is in no word, but none around itself."""
    return F.regexp_replace(normalized, NO_WORD, " # ")


def spaced(*parts: Column) -> Column:
    """Padded texts in a row, as one text that marks can be found in."""
    return F.concat(F.lit(" "), F.concat_ws(" ", *parts), F.lit(" "))


def marks_in(normalized: Column, text: Column, lexicon: Lexicon) -> Column:
    """The marks of the terms in a normalized text, which is given padded too.

    A term with more than plain letters is asked for by its own expression.
    """
    every = {mark(t): t for terms in lexicon.groups.values() for t in terms}
    of_words, others = {}, []
    for m, t in sorted(every.items()):
        if re.fullmatch("[a-z0-9_ ]+", m):
            of_words.setdefault(m.split()[0], []).append(m)
        else:
            others.append(F.when(normalized.contains(plain(t)) & normalized.rlike("(?U)" + pattern_of(t)), F.lit(m)))
    out = strings(())
    if of_words:
        known, words = lookup(of_words), F.array_distinct(F.filter(F.split(text, " "), lambda w: w.isin(*of_words)))
        out = F.filter(F.flatten(F.transform(words, lambda w: F.split(F.element_at(known, w), "\x1f"))), lambda m: text.contains(m))
    return F.concat(out, F.array_compact(F.array(*others))) if others else out


def marks_among(marks: Column, normalized: Column, text: Column, lexicon: Lexicon) -> Column:
    """Those of the marks of a whole text that one of its parts has."""
    others = {mark(t): t for terms in lexicon.groups.values() for t in terms if not re.fullmatch("[a-z0-9_ ]+", mark(t))}
    by_expression = lambda m: F.coalesce(*[F.when(m == k, normalized.contains(plain(t)) & normalized.rlike("(?U)" + pattern_of(t))) for k, t in sorted(others.items())], text.contains(m))
    return F.filter(marks, by_expression if others else lambda m: text.contains(m))


def groups_of(marks: Column, lexicon: Lexicon) -> Column:
    """The names of the groups that marks are of, in order."""
    table: dict[str, list[str]] = {}
    for g, terms in sorted(lexicon.groups.items()):
        for t in terms:
            table.setdefault(mark(t), []).append(g)
    if not table:
        return strings(())
    known = lookup(table)
    return let(marks, lambda ms: F.when(F.size(ms) > 0, F.array_sort(F.array_distinct(F.flatten(F.transform(ms, lambda m: F.split(F.element_at(known, m), "\x1f")))))).otherwise(strings(())))


def groups_in(normalized: Column, lexicon: Lexicon) -> Column:
    """The names of the groups with a term in a normalized text."""
    return let(normalized, lambda n: groups_of(marks_in(n, spaced(padded(n)), lexicon), lexicon))


def terms_of(marks: Column, lexicon: Lexicon) -> Column:
    """map<group, array<term>> of marks: their terms, in order; groups without one are left out."""
    every = [F.struct(F.lit(g).alias("key"), F.array(*[F.struct(F.lit(t).alias("term"), F.lit(mark(t)).alias("mark")) for t in sorted(set(terms))]).alias("value")) for g, terms in lexicon.groups.items() if terms]
    if not every:
        return F.create_map().cast("map<string,array<string>>")

    def entries(ms: Column) -> Column:
        own = lambda e: F.struct(e["key"].alias("key"), F.transform(F.filter(e["value"], lambda v: F.array_contains(ms, v["mark"])), lambda v: v["term"]).alias("value"))
        return F.map_from_entries(F.filter(F.transform(F.array(*every), own), lambda e: F.size(e["value"]) > 0).cast(TERMS))

    return let(marks, entries)


def terms_in(normalized: Column, lexicon: Lexicon) -> Column:
    """map<group, array<term>>: the terms in a normalized text, in order; groups without one are left out."""
    return let(normalized, lambda n: terms_of(marks_in(n, spaced(padded(n)), lexicon), lexicon))


def joined(parts: Column) -> Column:
    """The parts of a text that are not empty, a space between them."""
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def head(window: Column, normalized: Column) -> Column:
    """The first characters of a window, normalized; a short window is already."""
    return F.when(F.length(window) <= HEAD, normalized).otherwise(X.normalize(F.substring(window, 1, HEAD)))


def part(sentences: Column, window_id: Column) -> Column:
    """What a window has of an array with an entry for each sentence: window 2k is sentence k, the next one k and k + 1."""
    k = (window_id / 2).cast("int")
    return F.slice(sentences, k + 1, window_id % 2 + 1)


def window_ids(sentences: Column) -> Column:
    n = 2 * F.size(sentences) - 1
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def windows(found: Column, norms: Column, pads: Column, furniture: Column, marks: Column, lexicon: Lexicon) -> Column:
    """The windows with a term, page furniture skipped; ids count all windows.

    ``found``, ``norms`` and ``pads`` are the sentences of a text, the same
    normalized, and padded; ``furniture`` and ``marks`` are what the whole text has of them.
    """
    norm = lambda i: joined(part(norms, i))
    own = lambda i: let(spaced(joined(part(pads, i))), lambda p: F.struct(i.alias("i"), marks_among(marks, norm(i), p, lexicon).alias("terms")))
    some = F.filter(F.transform(window_ids(found), own), lambda w: (F.size(w["terms"]) > 0) & ~let(norm(w["i"]), lambda n: F.exists(furniture, lambda f: n.contains(f))))

    def entry(w: Column) -> Column:
        text = lambda t: F.struct(w["i"].alias("window_id"), F.substring(t, 1, HEAD).alias("window_text"), head(t, norm(w["i"])).alias("head"), w["terms"].alias("terms"), groups_of(w["terms"], lexicon).alias("groups"))
        return let(F.array_join(part(found, w["i"]), " "), text)

    return F.transform(some, entry)


def present(normalized: Column, values: Iterable[str]) -> Column:
    return F.filter(strings(values), lambda v: normalized.contains(v))


def matched_text(text: Column, lexicon: Lexicon) -> Column:
    """struct<terms, groups, windows> of a text, each part computed once; terms as marks."""

    def of(found: Column, norms: Column, pads: Column, n: Column, marks: Column) -> Column:
        furniture = present(n, X.FURNITURE.split("|"))
        shown = F.when(F.size(marks) > 0, let(furniture, lambda f: windows(found, norms, pads, f, marks, lexicon))).otherwise(F.array().cast(WINDOWS))
        return F.struct(marks.alias("terms"), groups_of(marks, lexicon).alias("groups"), shown.alias("windows"))

    marked = lambda found, norms, pads: let(joined(norms), lambda n: let(let(spaced(joined(pads)), lambda p: marks_in(n, p, lexicon)), lambda m: of(found, norms, pads, n, m)))
    return let(X.sentences(text), lambda found: let(F.transform(found, X.normalize), lambda norms: let(F.transform(norms, padded), lambda pads: marked(found, norms, pads))))


def heads(text: Column, findings: Iterable[str], then) -> Column:
    """``then(head)`` of each window of a text that is no page furniture, null where none of the findings can be in it."""
    clues = sorted({x for f in findings for x in P.needed(f)})

    def of(found: Column, norms: Column, n: Column, furniture: Column, clue: Column) -> Column:
        kept = F.filter(window_ids(found), lambda i: ~let(joined(part(norms, i)), lambda w: F.exists(furniture, lambda f: w.contains(f))))
        ids = F.when(F.size(furniture) > 0, kept).otherwise(window_ids(found))
        each = lambda i: let(joined(part(norms, i)), lambda w: F.when(F.exists(clue, lambda c: w.contains(c)), let(head(F.array_join(part(found, i), " "), w), then)))
        return let(ids, lambda k: F.when(F.size(clue) > 0, F.transform(k, each)).otherwise(F.transform(k, lambda i: F.lit(None))))

    whole = lambda found, norms, n: let(present(n, X.FURNITURE.split("|")), lambda f: let(present(n, clues), lambda c: of(found, norms, n, f, c)))
    return let(X.sentences(text), lambda found: let(F.transform(found, X.normalize), lambda norms: let(joined(norms), lambda n: whole(found, norms, n))))


def shows(normalized: Column, finding: str) -> Column:
    """Whether a finding is in a normalized window; its expression is only tried where the letters it needs are."""
    return let(normalized, lambda n: F.exists(strings(P.needed(finding)), lambda x: n.contains(x)) & n.rlike(P.tight(finding)))


def has(groups: Column, lexicon: Lexicon, *prefixes: str) -> Column:
    """Whether an array of group names holds one at or below a prefix."""
    names = lexicon.under(*prefixes)
    return F.arrays_overlap(groups, strings(names)) if names else F.lit(False)


def combo(found: Column, lexicon: Lexicon, first: tuple[str, ...], second: tuple[str, ...]) -> Column:
    """The windows with a group of both kinds."""
    return F.filter(found, lambda w: has(w["groups"], lexicon, *first) & has(w["groups"], lexicon, *second))
