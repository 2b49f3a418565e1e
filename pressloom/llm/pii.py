"""Personal data replaced by keyed surrogates of the same type, script and format.

Main path: DataFrame functions only. Entities are found by one regular
expression whose repeats are bounded or possessive, so a text costs time linear
in its length and no stack, whatever it holds. Kinds: mail addresses, IPv6 and
IPv4 addresses, access keys, hexadecimal tokens, named secrets, bank accounts,
phone numbers, payment cards (a bare run of digits only where its check sum
holds), social security numbers, and persons behind a title (or before one,
where the script has it so).

A surrogate is made by a keyed Feistel network over an entity's characters in
one case and without separators: in each of four rounds every other character
moves within its alphabet (digits, vowels or consonants of its script, a range
of letters where a script has no such classes) by an amount hashed from a digest
of the rest. That is a bijection on the strings of one format, in linear time,
so different entities keep different surrogates, and one entity has the same one
however it is spelt, across documents and jobs, without any table of entities.
Case and separators are put back afterwards. Mail domains move by themselves, so
one domain stays one domain; addresses move octet by octet; cards and accounts
keep their check sums (or the lack of one); phones keep the country. Given names
known by gender and script become others of the same list, other names of
persons are ciphered but for the last letter of cased scripts, which marks
gender; titles stay.

``checked`` looks for collisions on the corpus at hand and raises where one is
found; ``anonymised`` and ``clean`` run it.

Defined results: a null text stays null without entities; a null id and repeated
rows are carried along; further columns stay as they are; an empty table gives
an empty result; letters of scripts without an alphabet here stay.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import stored

#: A key for examples and tests; a deployment passes its own.
EXAMPLE_KEY = "pressloom-example-key"
TITLES = (
    "Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Herr|Frau|Señor|Señora|Señorita|Sr|Sra|Srta|Don|Doña|Monsieur|Madame|Mademoiselle|Mme|Mlle|Signor|Signora|Sig|Senhor|Senhora|Pan|Pani"
    "|Г-н|Г-жа|Господин|Госпожа|Κύριος|Κυρία|Κος|Κα|Պարոն|Տիկին"
)
PLAIN_TITLES = "السيد|السيدة|الدكتور|الدكتورة|מר|גברת|ד״ר|श्री|श्रीमती|सुश्री|ბატონი|ქალბატონი"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
HEXA = "[0-9A-Fa-f]{1,4}"
#: Letters of scripts that are written with spaces between words.
SPACED = r"[\p{L}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]]"
NAME = r"\p{Lu}[\p{L}\p{M}'’]{1,40}+"
KINDS = {
    "email": rf"(?<![A-Za-z0-9._%+-])(?:[A-Za-z0-9._%+-]{{1,64}}+|(?<![\p{{L}}\p{{N}}._%+-])(?:{SPACED}|[\p{{M}}\p{{N}}._%+-]){{1,64}}+)@"
    rf"(?:(?:[A-Za-z0-9-]{{1,63}}+\.){{1,126}}+[A-Za-z]{{2,63}}+|(?:(?:{SPACED}|[\p{{M}}\p{{N}}-]){{1,63}}+\.){{1,126}}+{SPACED}{{2,63}}+)",
    "ipv6": rf"(?<![\w:.])(?:(?:{HEXA}:){{7}}{HEXA}|(?:[23][0-9A-Fa-f]{{3}}|[fF][cCdDeE][0-9A-Fa-f]{{2}})(?::{HEXA}){{0,5}}+::(?:{HEXA}(?::{HEXA}){{0,5}}+)?+)(?![\w:])",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_])(?i:password|passwd|pwd|secret|api_?key)=[^\s\"'&=<>]{6,128}+",
    "token": r"(?<![A-Za-z0-9])(?:(?=[a-f]*+[0-9])[0-9a-f]{32,}+|(?=[A-F]*+[0-9])[0-9A-F]{32,}+)(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\)|[ .-][0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\+[0-9]{9,15}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])(?<![0-9]\.)(?:[0-9]{13,19}+|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|3[0-9]{3}([ -])[0-9]{6}\2[0-9]{4,5})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": rf"(?<!\p{{L}})(?:(?:{TITLES})\.? {NAME}(?:[ -](?:(?:von|van|der|de|del|la|di|da|dos|bin|al) ){{0,2}}+(?:{NAME}|\p{{Lu}}\.)){{0,3}}+|(?:{PLAIN_TITLES}) [\p{{L}}\p{{M}}]{{2,40}}+)"
    r"|[王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹]\p{IsHan}{0,2}?(?=先生|女士|小姐)|\p{IsHan}{1,4}(?=さん)|[김이박최정강조윤장임]\p{IsHangul}{1,2}(?= ?씨)",
}
ENTITY = "|".join(KINDS.values())
#: What no text with an entity lacks.
GATE = rf"[0-9@]|AKIA|ASIA|=|(?:{TITLES})\.? \p{{Lu}}|(?:{PLAIN_TITLES}) |先生|女士|小姐|さん|씨"

#: Alphabets a character moves in: lower case, each letter with one of its own in upper case.
DIGITS, HEX = "0123456789", "0123456789abcdef"
ALPHABETS = (
    DIGITS, "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüýāăąēĕėęěĩīĭįōŏőœũūŭůűų", "çðñþćĉċčďđĝğġģĥħĵķĺļľłńņňŋŕŗřśŝşšţťŧŵźżž",
    "аеёиоуыэюяіїє", "бвгджзйклмнпрстфхцчшщъьґўјљњћђџ", "αεηιουωάέήίόύώϊϋ", "βγδζθκλμνξπρστφχψ", "աեէըիոօ", "բգդզթժլխծկհձղճմյնշչպջռսվտրցփքֆ",
)
#: First and last code point of letters without case: Hebrew; Arabic; Indic vowels, consonants and signs; Thai; Georgian; kana; Han; Hangul.
RANGES = (
    (0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x905, 0x914), (0x915, 0x939), (0x93E, 0x94C), (0x995, 0x9A8), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3093), (0x30A1, 0x30F3), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
)
#: Given names by script and gender; one becomes another of its list.
GIVEN = (
    "james john robert michael david peter thomas daniel paul mark carlos luis pedro juan pierre jean hans klaus stefan marco",
    "mary anna susan linda laura emma julia sarah maria carmen lucía elena sophie claire ingrid heidi monika giulia marta irene",
    "иван пётр алексей сергей дмитрий николай андрей михаил", "анна мария ольга елена татьяна наталья ирина светлана",
    "γιώργος γιάννης νίκος κώστας δημήτρης πέτρος", "μαρία ελένη κατερίνα σοφία άννα δήμητρα",
    "محمد أحمد علي حسن يوسف عمر", "فاطمة مريم ليلى زينب سارة نور", "דוד משה יוסף יעקב אברהם דניאל", "שרה רחל לאה מרים רבקה חנה", "राम मोहन अमित राजेश विजय सुनील", "सीता गीता सुनीता अनीता पूजा प्रिया",
)
#: Kinds that are the same with other separators.
GROUPED, SEPARATORS = ("phone", "card", "iban", "ssn"), " ().+-"
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def given_names(key: str) -> dict[str, str]:
    """The surrogate of each known name: its list turned by a keyed amount."""
    out = {}
    for names in GIVEN:
        own = names.split()
        turn = 1 + int.from_bytes(hashlib.sha256(f"{key}|{names}".encode()).digest()[:8], "big") % (len(own) - 1)
        out |= {n: own[(k + turn) % len(own)] for k, n in enumerate(own)}
    return out


def turned(letters: str, at: Column, by: Column) -> Column:
    return F.substring(F.lit(letters), (F.pmod(at.cast("long") - 1 + by, F.lit(len(letters))) + 1).cast("int"), F.lit(1))


def shifted(c: Column, by: Column, kind: Column) -> Column:
    """A symbol moved within its alphabet; others stay. The symbols of an IPv4 address are its octets."""
    code, at = F.ascii(c).cast("long"), F.instr(F.lit(HEX), c)
    out = F.when(kind == "ip", F.pmod(c.cast("long") + by, F.lit(256)).cast("string")).when(kind.isin("token", "ipv6") & (at > 0), turned(HEX, at, by))
    for letters in ALPHABETS:
        at = F.instr(F.lit(letters), c)
        out = out.when(at > 0, turned(letters, at, by))
    for first, last in RANGES:
        moved = F.lit(first) + F.pmod(code - first + by, F.lit(last - first + 1))
        out = out.when(code.between(first, last), F.decode(F.unhex(F.lpad(F.hex(moved), 8, "0")), "UTF-32"))
    return out.otherwise(c)


def cipher(s: Column, kind: Column, key: str) -> Column:
    """Four rounds over the symbols of a text: those at even, then at odd places move by what the others say."""

    def turn(a: Column, k: Column) -> Column:
        own = lambda i: F.pmod(i, F.lit(2)) == F.pmod(k, F.lit(2))
        digest = F.sha2(F.concat(F.lit(f"{key}|"), k.cast("string"), F.lit("|"), kind, F.lit("|"), F.array_join(F.filter(a, lambda c, i: ~own(i)), "")), 256)
        return let(digest, lambda d: F.transform(a, lambda c, i: F.when(own(i), shifted(c, F.xxhash64(d, i.cast("long")), kind)).otherwise(c)))

    symbols = F.when(kind == "ip", F.split(s, r"\.")).otherwise(F.split(s, ""))
    return let(F.aggregate(F.expr("array(0, 1, 2, 3)"), symbols, turn), lambda a: F.when(kind == "ip", F.array_join(a, ".")).otherwise(F.array_join(a, "")))


def restored(s: Column, new: Column, grouped: Column) -> Column:
    """``new`` with the separators and the case of ``s``; a name of another length with its kind of case."""
    each = let(F.split(new, ""), lambda a: F.array_join(F.transform(F.split(s, ""), lambda c, i: let(F.get(a, F.when(grouped, F.length(F.translate(F.substring(s, F.lit(1), i + 1), SEPARATORS, "")) - 1).otherwise(i)), lambda n: (
        F.when(grouped & F.lit(SEPARATORS).contains(c), c).when(c != F.lower(c), F.upper(n)).otherwise(n)
    ))), ""))
    whole = F.when((s == F.upper(s)) & (F.length(s) > 1), F.upper(new)).otherwise(F.initcap(new))
    return F.when(~grouped & (F.length(s) != F.length(new)), whole).otherwise(each)


def part_of(p: Column, grouped: Column, key: str, names: Column) -> Column:
    """The surrogate of one part (kind, text); a part without kind stays."""
    kind, s, name = p["k"], p["s"], p["k"] == "name"

    def new(w: Column) -> Column:
        # the last letter of a cased word marks gender; a cipher that hits a known name goes on until it hits none
        last = F.when(name & (F.length(w) > 2) & (F.lower(F.right(w, F.lit(1))) != F.upper(F.right(w, F.lit(1)))), F.right(w, F.lit(1))).otherwise("")
        once = lambda x: F.concat(cipher(F.substring(x, F.lit(1), F.length(x) - F.length(last)), kind, key), last)
        walked = F.aggregate(F.expr("array(0, 1, 2, 3)"), w, lambda x, k: F.when((k == 0) | (name & F.element_at(names, x).isNotNull()), once(x)).otherwise(x))
        return F.coalesce(F.when(name, F.element_at(names, w)), walked)

    bare = F.lower(F.when(grouped, F.translate(s, SEPARATORS, "")).otherwise(s))
    return F.when(kind.isNull() | (s == ""), s).otherwise(let(bare, lambda b: let(new(b), lambda n: F.when(kind == "ip", n).otherwise(restored(s, n, grouped)))))


def parts(e: Column, kind: Column) -> Column:
    """The parts of an entity that move, with what steers them, and those that stay."""
    pick = lambda p, k: F.regexp_extract(e, p, k)
    part = lambda k, s: F.struct((F.lit(k) if k is None or isinstance(k, str) else k).cast("string").alias("k"), s.alias("s"))
    mail = r"^(.*)@(.*)(\.[^.]+)$"
    head = lambda p, k: let(pick(p, 0), lambda h: F.array(part(None, h), part(k, F.substring(e, F.length(h) + 1, F.length(e)))))
    words = lambda h: F.concat(F.array(part(None, h)), F.transform(F.split(F.substring(e, F.length(h) + 1, F.length(e)), "(?<=[ .-])|(?=[ .-])"), lambda w: part(F.when(~w.rlike(r"^(?:[ .-]|von|van|der|de|del|la|di|da|dos|bin|al|)$"), "name"), w)))
    return (
        F.when(kind == "email", F.array(part(F.concat(F.lit("mail|"), F.lower(pick(mail, 2)), F.lower(pick(mail, 3))), pick(mail, 1)), part(None, F.lit("@")), part("domain", pick(mail, 2)), part(None, pick(mail, 3))))
        .when(kind == "person", let(pick(rf"^(?:(?:{TITLES})\.?|{PLAIN_TITLES}) ", 0), words))
        .when(kind == "card", F.array(part("card", F.substring(e, F.lit(1), F.length(e) - 1)), part(None, F.right(e, F.lit(1)))))
        .when(kind == "iban", F.array(part(None, F.substring(e, 1, 4)), part("iban", F.substring(e, F.lit(5), F.length(e)))))
        .when(kind == "phone", head(COUNTRY, "phone"))
        .when(kind == "key", head("^A[KS]IA", "key"))
        .when(kind == "secret", head("^[^=]*=", "secret"))
        .otherwise(F.array(part(kind, e)))
    )


def luhn(card: Column) -> Column:
    """The check sum of the digits, 0 where it holds."""
    digit = lambda c, i: let(c.cast("int") * (F.lit(1) + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d))
    return F.aggregate(F.transform(F.split(F.reverse(F.translate(card, " -", "")), ""), digit), F.lit(0), lambda a, x: a + x) % 10


def proper_check(account: Column) -> Column:
    """The check digits that an account should have, 2 to 98."""
    bare = F.upper(F.translate(account, SEPARATORS, ""))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 2), F.lit("00"))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: let(F.instr(F.lit(DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1, lambda v: (a * F.when(v < 10, 10).otherwise(100) + v) % 97))
    return F.lit(98) - rest


def with_checks(e: Column, new: Column, kind: Column) -> Column:
    """Cards and accounts with check sums as good as the original's."""
    last = F.pmod(F.right(new, F.lit(1)).cast("int") - luhn(new) + luhn(e), F.lit(10))
    had = F.substring(e, 3, 2).cast("int")
    check = F.when(had.between(2, 98), F.pmod(had - proper_check(e) + proper_check(new) - 2, F.lit(97)) + 2).otherwise(had)
    return F.when(kind == "card", F.concat(F.substring(new, F.lit(1), F.length(new) - 1), last.cast("string"))).when(kind == "iban", F.concat(F.substring(new, 1, 2), F.lpad(check.cast("string"), 2, "0"), F.substring(new, F.lit(5), F.length(new)))).otherwise(new)


def kind_of(e: Column) -> Column:
    """The kind of a match; null for a run of digits that is no card."""
    out = F.lit("person")
    for k, p in reversed([(k, p) for k, p in KINDS.items() if k != "person"]):
        kind = F.when(e.rlike("[ -]") | (e.rlike("^[2-6]") & (luhn(e) == 0)), k) if k == "card" else F.lit(k)
        out = F.when(e.rlike(f"^(?:{p})$"), kind).otherwise(out)
    return out


def surrogate(e: Column, kind: Column, key: str) -> Column:
    """The replacement of one entity."""
    names = F.expr("map(" + ", ".join(f"'{a}', '{b}'" for a, b in given_names(key).items()) + ")")
    joined = F.array_join(F.transform(parts(e, kind), lambda p: part_of(p, kind.isin(*GROUPED), key, names)), "")
    return F.when(kind.isNull(), e).otherwise(let(joined, lambda new: with_checks(e, new, kind)))


def found(text: Column, key: str) -> Column:
    """(e, kind, surrogate) of each match in order; ``kind`` is null where it is none after all. Empty where the gate sees nothing."""
    all_of = F.regexp_extract_all(text, F.lit(ENTITY), 0)
    each = lambda e: let(kind_of(e), lambda k: F.struct(e.alias("e"), k.alias("kind"), surrogate(e, k, key).alias("surrogate")))
    none = F.array().cast("array<struct<e:string,kind:string,surrogate:string>>")
    return F.coalesce(F.when(text.rlike(GATE), F.transform(all_of, each)), none)


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``text`` replaced, and the matches in ``__found``."""
    seen = docs.withColumn("__found", found(F.col("text"), key))
    pieces = F.zip_with(F.split("text", ENTITY, -1), F.col("__found"), lambda g, s: F.concat(g, F.coalesce(s["surrogate"], F.lit(""))))
    return seen.withColumn("text", F.when(F.size("__found") == 0, F.col("text")).otherwise(F.array_join(pieces, "")))


def collisions(matches: DataFrame) -> DataFrame:
    """(kind, surrogate) that stand for several entities, spelling aside, among rows with ``__found``."""
    one = lambda c: F.lower(F.when(F.col("m.kind").isin(*GROUPED), F.translate(c, SEPARATORS, "")).otherwise(F.col(c)))
    each = matches.select(F.explode("__found").alias("m")).where("m.kind IS NOT NULL").select("m.kind", one("m.surrogate").alias("surrogate"), one("m.e").alias("e"))
    return each.groupBy("kind", "surrogate").agg(F.min("e").alias("least"), F.max("e").alias("most")).where("least <> most").select("kind", "surrogate")


def checked(docs: DataFrame, key: str) -> DataFrame:
    """``replaced``, written, after a look for collisions; raises where two entities share a surrogate."""
    out = stored(replaced(docs, key))
    if (clash := collisions(out).first()) is not None:
        raise ValueError(f"two entities of kind {clash.kind} share a surrogate")
    return out


def anonymised(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_entities, kinds)."""
    out = checked(docs.select("doc_id", F.col("text").cast("string").alias("text")), key)
    kinds = F.filter(F.transform("__found", lambda m: m["kind"]), lambda k: k.isNotNull())
    return out.select("doc_id", "text", F.size(kinds).cast("long").alias("n_entities"), F.array_sort(F.array_distinct(kinds)).alias("kinds"))


def clean(docs: DataFrame, key: str) -> DataFrame:
    """``docs``, all columns, with the texts replaced; ``n_chars``, if there, is brought up to date."""
    out = checked(docs, key).drop("__found")
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
