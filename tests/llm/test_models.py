"""Quality ledger, language model, tokenizer and packing."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import quality as measured
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pressloom.llm import bpe, langid, packing
from pressloom.llm import quality as Q

RANKS, JSON, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["", None, " ", "a", "héllo wörld", "  two  spaces ", "tabs\tand\nlines\r\n", "x" * 3000, "a" * 130 + "b" * 70, "don't we'll I'M", "1234567 89", "\x1c\x1d \x1e\x1f\x85\xa0  x", "日本語テキスト 한국어", "🙂🙃👨‍👩‍👧", "!!!???...", "<|endoftext|> is text", "\0 \0\0", " " * 200 + "end", "aé" * 400, "​﻿", "Áë"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(RANKS, public_tokenizers.PATTERN).ranks, special_tokens={})


def test_bpe_digests_match_the_library(spark, library):
    out = {r.doc_id: tuple(r)[1:] for r in bpe.digests(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).collect()}
    for k, t in enumerate(ODD):
        ids = library.encode_ordinary(t or "")
        assert out[k] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), repr(t)[:50]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text(st.sampled_from("ab 'sé\n\t1\x1c\xa0!"), max_size=120), st.text(st.sampled_from("abz"), min_size=60, max_size=600)))
def test_bpe_random(text):
    own = bpe.load(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own2", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    ids = own.encode(text).tolist()
    assert ids == library.encode_ordinary(text) and own.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abct hé"), min_size=1, max_size=400), st.data())
def test_join_is_the_encoding_of_both(text, data):
    own = bpe.load(RANKS, public_tokenizers.PATTERN)
    raw = text.encode()
    cut = data.draw(st.integers(0, len(raw)))
    whole = tiktoken.Encoding("own3", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})._core_bpe.encode_single_piece
    assert own.window(raw) == list(whole(raw))
    left, right = (whole(raw[:cut]) if cut else []), (whole(raw[cut:]) if cut < len(raw) else [])
    assert own.join(list(left), list(right)) == list(whole(raw)) == own.encode_piece(raw)


def test_every_word_goes_up_the_tree(spark):
    """Over a whole small table: the joins are counted, and nothing but the tree encodes."""
    own = bpe.Encoder(bpe.load(RANKS, public_tokenizers.PATTERN).ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own4", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert own.encode(r.text or "").tolist() == library.encode_ordinary(r.text or "")
    assert own.joins > len(own.known) > 1000


def test_long_pieces_and_repeated_rows(spark):
    texts = ["a" * 50_000, "ab" * 20_000, "日本" * 10_000, " " * 20_000, None]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)] + [(None, "a b", 1, "x")] * 2, "doc_id long, text string, ids int, n_tokens string")
    library = tiktoken.Encoding("own5", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load(RANKS, public_tokenizers.PATTERN).ranks, special_tokens={})
    out = bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert [r.n_tokens for r in sorted(out, key=lambda r: (r.doc_id is None, r.doc_id))] == [*(len(library.encode_ordinary(t or "")) for t in texts), 2, 2]
    assert bpe.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_bpe_round_trip(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    back = bpe.decoded(bpe.encoded(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.data) for r in back.collect()} == {k: (t or "").encode() for k, t in enumerate(ODD)}


def test_json_and_ranks_agree_with_tokenizers():
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    own = bpe.load(JSON, packing.GPT2)
    for t in ODD:
        assert own.encode(t or "").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)[:50]


# ---- packing ----------------------------------------------------------------


def packed(spark, texts, size=2048):
    df = spark.createDataFrame(list(texts), "doc_id long, text string")
    return [r.asDict() for r in packing.packed(df, JSON, size).collect()]


def test_packing_is_gapless_and_whole(spark):
    rng = random.Random(1)
    texts = [(k, " ".join(rng.choice(["alpha", "be", "gamma delta", "ñu"]) for _ in range(rng.choice([0, 1, 5, 40, 60, 300])))) for k in range(300)] + [(300, None), (301, "a b " * 900), (301, "a b " * 900), (None, "x")]
    rows, size = packed(spark, texts, 128), 128
    tokenizer = Tokenizer.from_file(JSON)
    assert sum(r["length"] for r in rows) == sum(len(tokenizer.encode(t or "").ids) + 1 for _, t in texts)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    least = max(-(-sum(r["length"] for r in rows) // size), sum(2 * r["length"] > size for r in rows))
    assert len(by_sequence) <= 1.03 * least + 1
    ids = [*tokenizer.encode("a b " * 900).ids, 0]
    own = sorted((r for r in rows if r["doc_id"] == 301), key=lambda r: r["piece"])[::2]
    assert own[0]["start"] == 0 and own[0]["length"] == (len(ids) % size or size) and all(r["length"] == size for r in own[1:])
    assert own[1]["ids_crc32"] == zlib.crc32(np.array(ids[own[1]["start"] : own[1]["start"] + size], "<u4").tobytes())


def test_packing_knows_added_tokens(spark):
    """As the library at its default setting."""
    tokenizer = Tokenizer.from_file(JSON)
    texts = [*ODD, "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "a  <|endoftext|>  \n", "<|endoftext|" + "> " * 3, "<|endoftext|> a" * 900]
    out = {}
    for r in packed(spark, enumerate(texts)):
        out.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    for k, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert sorted(out[k]) == [(x, n, zlib.crc32(np.array(ids[x : x + n], "<u4").tobytes())) for x, n, _ in sorted(out[k])] and sum(n for _, n, _ in out[k]) == len(ids), repr(t)[:50]


def test_packing_of_nothing(spark):
    assert packed(spark, []) == [] and [(r["length"], r["offset"]) for r in packed(spark, [(1, None)])] == [(1, 0)]


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_plans_use_every_piece_once(have):
    used, total = {}, 0
    for lengths, n in packing.plan(have, 64):
        assert sum(lengths) <= 64 and n > 0
        total += n
        for k in lengths:
            used[k] = used.get(k, 0) + n
    assert used == have
    assert total <= sum(n for _, n in packing.best_fit({k: n for k, n in have.items() if k < 64}, 64)) + have.get(64, 0)


# ---- quality ----------------------------------------------------------------

LINES = "uno dos tres\nuno dos tres\n\n \nuno  dos tres\n" * 3
QUALITY = [*ODD, LINES, "a b c d e " * 4, "a b c d e f g h i j k l", "# * $ % & | < > " * 3, "one two three four five six seven eight nine ten eleven " + "x" * 40, "a\x0bb\x0cc d\x85e f"]


def test_measurements_match_brute_force(spark):
    out = {r.doc_id: r for r in Q.verdicts(spark.createDataFrame(list(enumerate(QUALITY)), "doc_id long, text string")).collect()}
    for k, t in enumerate(QUALITY):
        r, m = out[k], measured(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m, repr(t)[:40]
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0]) and (not r.kept or not r.base_failed)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\t#é"), max_size=80))
def test_measurements_random(text):
    m = Q.measurements(text)
    assert (m[0], m[1], m[2], m[4], m[5]) == measured(text)


def test_ablations(spark):
    held = Q.ledger(spark.createDataFrame(list(enumerate(QUALITY)), "doc_id long, text string"))
    rows, found = held.collect(), {r.rule: (r.failed, r.failed_alone) for r in Q.ablations(held, "v1").collect()}
    for k, rule in enumerate(Q.RULES):
        assert found[rule.name] == (sum(r.fail_bits >> k & 1 for r in rows), sum(r.fail_bits == 1 << k for r in rows))
    assert Q.mask("base") == 3 and Q.verdicts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- language ---------------------------------------------------------------

SAYINGS = {
    "en": "the quick brown fox jumps over the lazy dog and then it runs through the forest while the people are watching",
    "es": "el perro corre por el bosque mientras la gente mira desde la ventana y nadie dice una palabra sobre aquello",
    "de": "der schnelle Hund springt über den faulen Fuchs und läuft dann durch den Wald während die Leute zuschauen",
}


def labelled(n=40):
    rng = random.Random(3)
    rows = []
    for lang, saying in SAYINGS.items():
        for _ in range(n):
            rows.append((len(rows), " ".join(rng.choice(saying.split()) for _ in range(12)), lang))
    return rows


def segmentations(word, p, unknown):
    """The sum over all segmentations, recursively."""
    if not word:
        return 1.0
    return sum(p.get(word[:k], unknown if k == 1 else 0.0) * segmentations(word[k:], p, unknown) for k in range(1, len(word) + 1))


def test_forward_algorithm_sums_all_segmentations():
    pieces = langid.Pieces(PIECES)
    own = {"▁", "▁h", "ho", "o", "l", "la", "▁hola", "a"}
    rng = np.random.default_rng(1)
    table, p = np.zeros((pieces.size, 1)), {}
    for piece in own:
        at = np.flatnonzero(pieces.hashes == np.uint64(pieces.hash_of(piece)))
        if len(at):
            p[piece] = table[pieces.ids[at[0]], 0] = rng.random()
    words = ["hola", "la", "xhola", "o"]
    with np.errstate(divide="ignore"):
        found = np.exp(langid.log_probabilities(words, pieces, table)[:, 0])
    # known pieces without a probability count as zero
    known = {q: 0.0 for w in words for i in range(len(w) + 2) for j in range(i + 1, len(w) + 2) for q in [("▁" + w)[i:j]] if q and np.uint64(pieces.hash_of(q)) in pieces.hashes}
    assert np.allclose(found, [segmentations("▁" + w, known | p, langid.UNKNOWN) for w in words])


def test_languages_are_told_apart(spark):
    docs = spark.createDataFrame(labelled(), "doc_id long, text string, lang string")
    model = langid.Model.fit(docs.where(~langid.held_out()), PIECES)
    out = langid.predictions(docs, model).collect()
    truth = {i: lang for i, _, lang in labelled()}
    held = [r for r in out if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in out)


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame(labelled(), "doc_id long, text string, lang string")
    model = langid.Model.fit(docs, PIECES)
    odd = spark.createDataFrame([(1, None, None), (2, "123 !!", "en"), (3, "", None), (None, "the dog", None), (5, "perro " * 5000, "xx"), (6, "x" * 5000, None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.predictions(odd, model).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3, None, 5)] == ["und", "und", "und", "en", "es"] and out[1].score == 0 and out[None].held_out is False
    assert sorted(r.doc_id or 0 for r in langid.accepted(odd, model).collect())[:1] == [0] and langid.accepted(odd, model).columns == odd.columns
    nothing = langid.Model.fit(docs.where("lang IS NULL"), PIECES)
    assert {r.lang_pred for r in langid.predictions(odd, nothing).collect()} == {"und"} and langid.predictions(odd.limit(0), model).count() == 0
