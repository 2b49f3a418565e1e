"""Text functions as Column expressions; they stay inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, and the information separators; and those that end no line. Characters one by one are one
#: table to the engine, and the rest hides behind one range, so a letter is told by two looks.
_WIDE = r"\u1680\u2000-\u200a\u202f\u205f\u3000"
SPACE = rf"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0[\u1680-\u3000&&[{_WIDE}\u2028\u2029]]]"
INLINE = rf"[\t\x1f\x20\xa0[\u1680-\u3000&&[{_WIDE}]]]"
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: What ends a line, as in Unicode's line breaks plus the information separators.
LINE_END = "[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
# Phrases of page furniture in plain spelling, and of lines that are dropped (lower case, accents kept), in order.
FURNITURE = "buscar clarin|cerrar sesion|leidas comentadas|lo mas leido|mas comentadas|mas leidas|mi cuenta|newsletter|notas relacionadas|noticias deportes extrashow|relacionadas|servicios|tops clarin|ultimas noticias"
DROPPED = "comentarios|compartir en facebook|compartir en twitter|desde su móvil acceda|newsletter|política de privacidad|sitio desarrollado con software libre|síguenos en|todos los derechos reservados"


@cache
def _plain_letters() -> tuple[str, str]:
    """Characters that decompose to one base character and marks, and those base characters."""
    pairs = []
    for code in range(0xC0, 0xFFFF):
        parts = unicodedata.normalize("NFD", chr(code)) if not 0xD800 <= code <= 0xDFFF else ""
        base = [c for c in parts if unicodedata.category(c) != "Mn"]
        if len(parts) > 1 and len(base) == 1:
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def one_space(c: Column) -> Column:
    """Each run of white space as one space; lone spaces are left as they are."""
    return F.regexp_replace(c, f"{SPACE}(?:(?<! ){SPACE}*+|{SPACE}++)", " ")


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize(c: Column) -> Column:
    """Without accents, lower case, white space runs as one space, trimmed; null as empty."""
    plain = lambda t: F.regexp_replace(F.translate(t, *_plain_letters()), r"\p{Mn}+", "")
    low = lambda t: F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.lower(plain(t)))
    return F.trim(one_space(let(blank(c), low)))


def repair_mojibake(c: Column) -> Column:
    """UTF-8 read as Latin-1 is read anew, where that leaves fewer of the telling letter; else the text as it is."""
    text = blank(c)
    telling = lambda s: F.length(s) - F.length(F.replace(s, F.lit("Ã"), F.lit("")))
    fixed = F.make_valid_utf8(F.encode(F.regexp_replace(text, r"[^\x{0}-\x{ff}]", ""), "ISO-8859-1").cast("string"))
    fixed = F.replace(fixed, F.lit("\ufffd"), F.lit(""))
    return F.when(text.contains("Ã"), F.when(telling(fixed) < telling(text), fixed).otherwise(text)).otherwise(text)


def normalize_spaces(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(blank(c), "\r\n?", "\n"), "[ \t]+", " ")
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def lines(c: Column) -> Column:
    """The lines, stripped, without blank ones: white space with a line's end in it is one line feed."""
    return strip(F.regexp_replace(blank(c), f"{SPACE}(?:(?<={LINE_END})|(?<!{SPACE}{SPACE}){INLINE}*+{LINE_END}){SPACE}*+", "\n"))


def remove_flip_blocks(c: Column) -> Column:
    """Drops each line that says flip, the one after it, and a lone dash before it."""
    text = F.array_join(F.transform(F.split(blank(c), f"\r\n|{LINE_END}"), strip), "\n")
    text = F.regexp_replace(text, r"(?m)^(?:-\n)?(?iu:flipear)(?:\n[^\n]*)?(?:\n|\z)", "")
    return F.array_join(F.filter(F.split(text, "\n"), lambda s: s != ""), "\n")


def holds(text: Column, phrases: str) -> Column:
    """Whether one of the phrases between bars is in a text."""
    return let(text, lambda t: F.exists(F.split(F.lit(phrases), r"\|"), lambda p: t.contains(p)))


def remove_boilerplate(c: Column) -> Column:
    """Lines are only looked at one by one where the text holds what is dropped."""
    kept = lambda t: F.array_join(F.filter(F.split(t, "\n"), lambda s: ~F.lower(s).rlike(DROPPED)), "\n")
    return let(lines(c), lambda t: F.when(holds(F.lower(t), DROPPED), kept(t)).otherwise(t))


def clean_text(text: Column, source: Column) -> Column:
    """The cleaning that the source asks for."""
    flipped = lambda t: F.when(t.rlike("(?iu)flipear"), remove_flip_blocks(t)).otherwise(t)
    own = lambda t: F.when(F.lower(blank(source)) == "eluniversal_mx", flipped(t)).otherwise(t)
    # what is left are stripped lines, so there is no other space to mend
    return let(remove_boilerplate(let(repair_mojibake(text), own)), lambda t: F.when(t.contains("\t") | t.contains("  "), F.regexp_replace(t, "[ \t]+", " ")).otherwise(t))


def clean_title(title: Column) -> Column:
    return normalize_spaces(repair_mojibake(title))


def sentences(c: Column) -> Column:
    """Cut behind a full stop, question or exclamation mark with white space, and at line ends."""
    return F.filter(F.transform(F.split(blank(c), f"{SPACE}(?:(?<=[.?!]{SPACE}){SPACE}*+|(?<=\n)\n*+)"), strip), lambda s: s != "")


def sentence_windows(found: Column) -> Column:
    """Each sentence, and each with the next, in order."""
    pair = lambda s, i: F.when(i + 1 < F.size(found), F.array(s, F.concat_ws(" ", s, F.get(found, i + 1)))).otherwise(F.array(s))
    return F.flatten(F.transform(found, pair))


def is_furniture(normalized: Column) -> Column:
    return holds(normalized, FURNITURE)


def excerpt(c: Column, n: int = 600) -> Column:
    return F.substring(strip(one_space(blank(c))), 1, n)


def first_nonblank(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(strip(c.cast("string")), F.lit("")) for c in columns], F.lit(""))


def normalize_label(c: Column) -> Column:
    return F.lower(strip(blank(c)))


def quoted(words: str) -> str:
    """An alternation of the phrases between bars, as literals."""
    return "|".join(re.escape(w) for w in words.split("|"))
