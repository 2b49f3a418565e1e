"""SimHash, suffix-array and embedding dedup against brute force."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import groups, simhash, without_repeats
from pyspark import cloudpickle

from pressloom.llm import common, substrings, vectors
from pressloom.llm import simhash as S

# so that sizes set by a test reach the workers
for module in (common, substrings, vectors):
    cloudpickle.register_pickle_by_value(module)

RNG = random.Random(5)
VOCABULARY = [f"w{k}é" if k % 7 == 0 else f"Word{k}" for k in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, n, rng=RNG):
    words = text.split(" ")
    for k in rng.sample(range(len(words)), n):
        words[k] = rng.choice(VOCABULARY)
    return " ".join(words)


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def copies():
    """Texts with exact copies, near copies, empty and odd ones."""
    base = [prose(RNG.randint(3, 300)) for _ in range(60)]
    texts = base + [edited(t, max(1, len(t.split()) // 200)) for t in base for _ in range(2)] + base[:10] + ["", None, " \n\t", "one", "One", "one two", "a\x1cb c\xa0d e", "ÀÉ x y z", "x " * 5000]
    return [(100 - k if k % 2 else 100 + k, t) for k, t in enumerate(texts)]


def test_simhash_matches_brute_force(spark, copies):
    fps = {i: simhash(t) for i, t in copies}
    close = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    root = groups(fps, close)
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_components(table(spark, copies).repartition(3)).collect()}
    assert out == {i: (f"{fps[i]:016x}", root[i]) for i in fps} and len(set(root.values())) < len(root)


def test_masks_cover_every_pair_of_bits():
    masks = [m % (1 << 64) for m in S.covering_masks()]
    for bits in itertools.chain(((i,) for i in range(64)), itertools.combinations(range(64), 2)):
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


@pytest.mark.parametrize("d", [3, 4])
def test_stripes_cover_their_radius(d):
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(0, 2**64, (1, S.LANES), np.uint64)
        width = min(64 * S.LANES // S.STRIPES, round(6.25 * d))
        y = x.copy()
        for bit in rng.choice(width * S.STRIPES, d * S.STRIPES - 1, False):
            y[0, bit // 64] ^= np.uint64(1) << np.uint64(63 - bit % 64)
        assert (S.stripe_keys(x, d) == S.stripe_keys(y, d)).any()


def test_links_of_a_radius_are_complete(spark):
    """Fingerprints at every distance from a few centres."""
    rng = np.random.default_rng(3)
    fps = []
    for c in rng.integers(0, 2**64, 30, np.uint64).tolist():
        fps += [c] + [c ^ sum(1 << b for b in rng.choice(64, k, False).tolist()) for k in (1, 2, 2, 3, 4)]
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(set(fps))]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = groups(signed, [(r.a, r.b) for r in S.near_edges(df).collect()])
    assert found == groups(signed, [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 2])


def test_similar_groups_find_near_copies(spark):
    rng = random.Random(11)
    base = [prose(rng.randint(60, 400), rng) for _ in range(40)]
    rows, family = [], {}
    for k, t in enumerate(base):
        for c in range(6):
            doc_id = 1000 * k + c
            rows.append((doc_id, t if c == 0 else edited(t, max(1, len(t.split()) // 60), rng)))
            family[doc_id] = k
    out = {r.doc_id: r.component_id for r in S.similar_groups(table(spark, rows)).collect()}
    assert all(family[i] == family[c] for i, c in out.items()), "different texts were joined"
    assert sum(c == 1000 * family[i] for i, c in out.items()) >= 0.97 * len(out)
    kept = S.deduplicate(table(spark, rows)).count()
    assert 40 <= kept <= 47


def test_similar_groups_hold_no_pair_below_the_similarity(spark):
    """Pairs at every similarity, also where the fingerprints are near; the links are those of the shingle sets."""
    rng = random.Random(12)
    rows = []
    for k in range(60):
        t = prose(200, rng)
        rows += [(10 * k, t), (10 * k + 1, edited(t, 2 + k % 8, rng)), (10 * k + 2, edited(t, 4, rng))]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.lower().split(" ")) for i, t in rows)}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    links = [p for p in itertools.combinations(sets, 2) if alike(*p)]
    expected = groups(sets, links)
    out = {r.doc_id: r.component_id for r in S.similar_groups(table(spark, rows)).collect()}
    assert len(links) > 30 and all(expected[i] == expected[c] for i, c in out.items()), "texts below the similarity were joined"
    assert sum(out[i] != expected[i] for i in out) <= 0.02 * len(out)


def test_buckets_do_not_fill_with_the_corpus(spark):
    """Texts without a common shingle meet in no bucket, however many there are; before, the pairs grew with their square."""
    sets = [np.random.default_rng(k).integers(0, 2**64, 40, np.uint64) for k in range(20_000)]
    keys = np.concatenate([S.band_keys(h) for h in sets])
    assert len(np.unique(keys)) == len(keys) == 20_000 * S.BANDS


@pytest.mark.parametrize("n", [5, 40, 1500])
def test_keys_are_shared_at_the_similarity(n):
    rng, lost = np.random.default_rng(n), 0
    for _ in range(1000):
        h = rng.integers(0, 2**64, n, np.uint64)
        k = -(-4 * n // 5)
        half = (n - k) // 2
        lost += not (S.band_keys(np.sort(h[: k + half])) == S.band_keys(np.sort(np.append(h[:k], h[k + half :])))).any()
    assert lost <= 5


@pytest.mark.parametrize("few", [0, 10_000])
def test_spanned_pairs_join_what_all_pairs_join(monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    rng = np.random.default_rng(2)
    fps = np.repeat(rng.integers(0, 2**64, 40, np.uint64), 15) ^ (np.uint64(1) << rng.integers(0, 64, 600, np.uint64))
    t = pa.table({"group": np.sort(rng.integers(0, 6, 600)), "side": rng.integers(0, 2, 600) + 2 * (np.arange(600) > 300), "fp": rng.permutation(fps).view(np.int64)})
    t = t.set_column(1, "side", pa.array(np.minimum(t.column("side").to_numpy(), 2)))
    joined = [groups(range(600), [(a, b) for i, j in of(t, ["fp"], 2) for a, b in zip(i.tolist(), j.tolist())]) for of in (S.close, S.spanned)]
    assert joined[0] == joined[1] and len(set(joined[0].values())) < 500


def test_texts_of_one_repeated_id(spark):
    """Texts that share a doc_id are dealt by what they hold, so they don't multiply in the buckets."""
    rng = random.Random(13)
    base = [prose(80, rng) for _ in range(150)]
    rows = [(1, t) for t in base] + [(2 + k, edited(t, 1, rng)) for k, t in enumerate(base[:40])]
    out = S.similar_groups(table(spark, rows)).collect()
    assert len(out) == len(rows) and sum(r.component_id == 1 for r in out) >= 188


def test_similar_groups_of_odd_rows(spark):
    rows = [(3, None), (1, ""), (2, " "), (5, "one"), (4, "one"), (None, "one"), (None, None), (4, "one two")]
    out = sorted(((r.doc_id, r.component_id) for r in S.similar_groups(table(spark, rows)).collect()), key=str)
    assert out == sorted([(3, 1), (1, 1), (2, 1), (5, 4), (4, 4), (None, None), (None, None), (4, 4)], key=str)
    kept = S.deduplicate(table(spark, rows).withColumnsRenamed({}))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, ""), (4, "one"), (None, "one"), (None, None)], key=str)


def test_simhash_of_nothing(spark):
    assert S.near_components(table(spark, [])).count() == S.similar_groups(table(spark, [])).count() == S.deduplicate(table(spark, [])).count() == 0


def test_simhash_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 7, 8, 9)], "doc_id long, text string, fp int, node int, root int")
    assert S.deduplicate(df).columns == df.columns and S.near_components(df).count() == 1
    null = S.near_components(table(spark, [(None, "a"), (2, "a")])).orderBy("doc_id").collect()
    assert [(r.doc_id, r.component_id) for r in null] == [(None, None), (2, 2)]


def test_components(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5), (7, 7000)]
    out = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = groups({x for p in links for x in p}, links)
    assert {k: v for k, v in groups(out, out.items()).items()} == {k: v for k, v in expected.items() if k in out} and len(out) == 302


# ---- substrings -------------------------------------------------------------


def passages():
    rng = random.Random(2)
    shared = [prose(40, rng) for _ in range(5)]
    texts = [prose(30, rng) + " " + rng.choice(shared) + " " + prose(rng.randint(1, 60), rng) for _ in range(40)]
    texts += [texts[0], texts[0], texts[3][10:], "short", "", None, "ab" * 200, "x" * 99, "x" * 100, "x" * 100, "y" * 101, "é" * 150, " " * 300, shared[0][:99], shared[0][:100], shared[0] + shared[0]]
    texts += [edited(texts[5], 2, rng) for _ in range(30)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(k, t) for k, t in zip(order, texts)]


def digests(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.digests(df).collect()}


@pytest.mark.parametrize("sizes", [{}, {"CHUNK": 2000, "BUCKET": 4000, "BATCH": 64, "FAMILY": 200}, {"CHUNK": 5000, "BUCKET": 10_000, "HOT": 1, "PARTITIONS": 3}, {"BLOCK": 512, "HOT": 3, "BATCH": 1}])
def test_substrings_match_brute_force(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(substrings, k, v)
    rows = passages()
    assert digests(table(spark, rows).repartition(5)) == without_repeats(rows)


def test_hot_passage_in_every_text(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 8)
    monkeypatch.setattr(substrings, "CHUNK", 1000)
    rng = random.Random(4)
    hot = prose(60, rng)
    rows = [(k, prose(rng.randint(0, 30), rng) + hot + prose(rng.randint(0, 30), rng)) for k in range(120)]
    assert digests(table(spark, rows).repartition(6)) == without_repeats(rows)


def test_substrings_of_odd_rows(spark):
    text = prose(50)
    out = sorted(substrings.digests(table(spark, [(None, text), (None, None), (7, text), (7, text), (1, "x")])).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_removed))
    n = len(text.encode())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in out) == [("1", 1, 0), ("7", n, n), ("7", n, n), ("None", 0, 0), ("None", n, 0)]
    assert substrings.digests(table(spark, [])).count() == 0


def test_families_and_scans():
    rng = np.random.default_rng(3)
    windows = np.array([bytes(rng.integers(0, 3, 6, np.uint8)).ljust(100, b"q") for _ in range(900)], "S100")
    family, seen = substrings.Family(), set()
    for at in range(0, len(windows), 70):
        batch = windows[at : at + 70]
        assert family.add(batch).tolist() == [not (w in seen or seen.add(w)) for w in batch.tolist()]
        sizes = [len(level) for level in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and all((level[1:] > level[:-1]).all() for level in family.levels)


def test_substrings_of_long_texts_and_clashes(spark):
    long = prose(60_000)
    df = spark.createDataFrame([(1, long, "a", 5), (2, "x" + long, "b", 6), (3, "z" * 400_000, None, None)], "doc_id long, text string, marks string, bucket int")
    out = {r.doc_id: r for r in substrings.digests(df).collect()}
    n = len(long.encode())
    assert out[1].n_removed == 0 and (out[2].n_bytes, out[2].n_removed, out[2].n_spans) == (n + 1, n, 1) and out[3].n_removed == 399_999
    assert substrings.without_repeats(df).columns == df.columns and {r.doc_id: r.text for r in substrings.without_repeats(df).collect()}[2] == "x"


def test_texts_without_repeats(spark):
    passage = prose(40)
    df = spark.createDataFrame([(1, "a " + passage + " b", "de", 9, 1), (2, "c " + passage + " d", None, None, 2), (3, None, "x", 5, 3)], "doc_id long, text string, lang string, n_chars long, chunk int")
    out = {r.doc_id: r for r in substrings.without_repeats(df).collect()}
    assert out[1].text == "a " + passage + " b" and out[2].text == "cd" and out[2].n_chars == 2 and out[3].text is None and out[3].n_chars == 5 and out[2].chunk == 2


def test_character_cut_in_part(spark):
    df = table(spark, [(1, "é" * 60 + "x"), (2, "ñ" + "é" * 60)])
    out = {r.doc_id: r.text for r in substrings.without_repeats(df).collect()}
    assert out[2] == "ñ"


# ---- vectors ----------------------------------------------------------------


def unit(v):
    if v is None or not len(v) or any(a is None or not math.isfinite(a) for a in v) or not any(v):
        return None
    x = np.array(v, np.float64)
    return x / np.sqrt(x @ x)


def vector_rows():
    rng = np.random.default_rng(9)
    rows = []
    for k in range(60):
        c = rng.standard_normal(24)
        for m in range(rng.integers(1, 8)):
            x = (c + rng.standard_normal(24) * rng.choice([0, 0.05, 0.1, 0.2])).astype(np.float32)
            rows.append((len(rows) * 3 % 1009, [float(a) for a in x], int(k % 3) if k % 5 else None))
    zero, same = [0.0] * 24, [1.0] * 24
    rows += [(5000, None, 1), (5001, zero, 1), (5002, [None] * 24, 1), (5003, [float("nan")] * 24, 1), (5004, [float("inf")] + [1.0] * 23, 1), (5005, [], 1)]
    rows += [(5010 + k, same, 1) for k in range(4)] + [(5020, [2.0] * 24, 1), (5021, [1e-30] * 24, 1), (5022, [-1.0] * 24, 1), (5023, [1.0] * 12, 1), (5024, [1.0] * 12, 1)]
    return rows


def linked_by_force(rows, threshold=0.98):
    """Indices of linked rows."""
    units = [unit(v) for _, v, _ in rows]
    return [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if rows[i][2] is not None and rows[i][2] == rows[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold]


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 5, "PAIRS": 7}])
def test_vectors_match_brute_force(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(common if k == "PAIRS" else vectors, k, v)
    rows = vector_rows()
    links = [(rows[i][0], rows[j][0]) for i, j in linked_by_force(rows)]
    root, degree = groups([r[0] for r in rows], links), {r[0]: 0 for r in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert out == {i: (degree[i], root[i], i == root[i]) for i in degree}


def test_vectors_of_odd_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], None)], "vec_id long, embedding array<float>, label int")
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in vectors.near_components(df).collect()), key=str) == sorted([(None, 0, None), (1, 1, 1), (1, 1, 1), (2, 0, 2)], key=str)
    assert vectors.near_components(df.where("vec_id > 9")).count() == 0
    clash = df.selectExpr("*", "1 AS node", "'x' AS v", "2 AS n_links", "3 AS kept", "4 AS m")
    assert vectors.near_components(clash).columns == ["vec_id", "n_links", "component_id", "kept"] and vectors.near_components(clash).count() == 4


def test_repeated_ids_are_vectors_each(spark):
    """Whatever the order of the rows, one id with several vectors gives the same rows."""
    near, far = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, near, 1), (2, near, 1), (2, far, 1), (3, far, 1), (3, far, 2)]
    expected = sorted([(1, 1, 1), (2, 1, 1), (2, 1, 2), (3, 1, 2), (3, 0, 3)])
    for own in (rows, rows[::-1]):
        df = spark.createDataFrame(own, "vec_id long, embedding array<float>, label int").repartition(3)
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_components(df).collect()) == expected


def planted(n=3000, d=64, label=1, seed=4):
    """Random vectors, and for each one at a cosine of 0.98 to 0.985."""
    rng = np.random.default_rng(seed)
    x = vectors.unit(rng.standard_normal((n, d)))
    e = rng.standard_normal((n, d))
    e = vectors.unit(e - (e * x).sum(1, keepdims=True) * x)
    c = rng.uniform(0.9800001, 0.985, (n, 1))
    return x, c * x + np.sqrt(1 - c * c) * e


def test_stripes_and_estimates_never_lose_a_pair():
    x, y = planted()
    turn = vectors.rotation(64)
    a, b = x @ turn, y @ turn
    home = vectors.home(a, b, 0.98)
    for side in (a, b):
        rows, keys = vectors.reached(side, 0.98)
        assert set(zip(range(len(a)), home.tolist())) <= set(zip(rows.tolist(), keys.tolist()))
    assert (vectors.home(b, a, 0.98) == home).all()
    both = vectors.codes(np.vstack((a, b)))
    i = np.arange(len(a))
    assert vectors.possible(both, 64, i, i + len(a), 0.98).all()
    apart = np.random.default_rng(1).permutation(len(a))
    assert vectors.possible(both, 64, i, apart[i], 0.98)[apart != i].mean() < 0.01, "unlike pairs are told by bits alone"


def test_vectors_are_sent_once_for_each_block(spark, monkeypatch):
    """Before, each vector was dealt to some 126 buckets, whatever it met there."""
    x, y = planted(1500)
    sent, judge = [], vectors.undecided
    monkeypatch.setattr(vectors, "undecided", lambda met, threshold: sent.append(met.count()) or judge(met, threshold))
    df = spark.createDataFrame([(k, r, 1) for k, r in enumerate(np.vstack((x, y)).tolist())], "vec_id long, embedding array<double>, label int")
    assert vectors.near_components(df).where("n_links >= 1").count() == 3000 and sent == [3000]


@pytest.mark.parametrize("tile", [(3, 4), (7, 2), (1000, 1000)])
def test_tiles_hold_every_pair_once(monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    group = np.array([1] * 11 + [2] * 9)
    side = np.array([2] * 11 + [0, 1, 1, 0, 1, 0, 1, 1, 1])
    found = [tuple(sorted((i, j))) for rows, columns, alone in vectors.tiles(group, side) for i in rows.tolist() for j in columns.tolist() if not alone or i < j]
    assert sorted(found) == [(i, j) for i in range(20) for j in range(i + 1, 20) if group[i] == group[j] and (side[i] == 2 or side[i] != side[j])]


@pytest.mark.parametrize("tile", [(5, 9), (64, 32)])
def test_small_tiles_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rows = vector_rows()
    links = [(rows[i][0], rows[j][0]) for i, j in linked_by_force(rows)]
    root, degree = groups([r[0] for r in rows], links), {r[0]: 0 for r in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    out = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert out == {i: (degree[i], root[i]) for i in degree}


def test_twenty_thousand_planted_vectors(spark):
    x, y = planted(10_000)
    rows = np.vstack((x, y))
    df = spark.createDataFrame([(k, r, k % 10_000 % 4) for k, r in enumerate(rows.tolist())], "vec_id long, embedding array<double>, label int")
    out = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_components(df).collect()}
    exact = np.zeros(len(rows), int)
    for k in range(4):
        own = np.flatnonzero(np.arange(len(rows)) % 10_000 % 4 == k)
        near = rows[own] @ rows[own].T / np.outer(np.linalg.norm(rows[own], axis=1), np.linalg.norm(rows[own], axis=1)) >= 0.98
        exact[own] = near.sum(1) - 1
    assert exact.sum() >= 20_000 and [out[k][0] for k in range(len(rows))] == exact.tolist()
    assert all(out[k] == out[k + 10_000] == (1, k) for k in range(10_000) if exact[k] == exact[k + 10_000] == 1)
