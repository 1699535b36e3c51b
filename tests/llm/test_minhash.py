import random
from collections import Counter

import numpy as np
import pytest

from strandloom.llm import minhash
from strandloom.llm.common import Scratch
from strandloom.llm.graph import components
from strandloom.llm.minhash import linked, minima, near_duplicates
from strandloom.llm.shingles import shingle_sets

from .cases import EDGES, WORDS, documents, ids


def shingles(text, width: int) -> frozenset:
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width: int, percent: int) -> dict:
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault(r[0], []).append(shingles(r[1], width))
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    keys = sorted(sets)
    for a in range(len(keys)):
        for b in range(a + 1, len(keys)):
            for x in sets[keys[a]]:
                for y in sets[keys[b]]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = root(keys[a]), root(keys[b])
                        up[max(p, q)] = min(p, q)
    return {i: root(i) for i in keys}


def edited(rng, words: list[str], share: float) -> str:
    return " ".join(rng.choice(WORDS) + "x" if rng.random() < share else w for w in words)


def family(seed: int, n: int, size: int) -> list:
    rng = random.Random(seed)
    base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(size)]
    return [(1000 * seed + i, edited(rng, base, rng.choice([0, 0.005, 0.02, 0.05])), "en", "a", 1) for i in range(n)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_against_all_pairs(spark, width, percent):
    rows = EDGES + family(1, 60, 150) + family(2, 25, 30) + family(3, 10, 800) + family(4, 15, 6)
    got = near_duplicates(documents(spark, rows), width, percent).collect()
    assert ids(got) == ids(rows)
    want = brute(rows, width, percent)
    sizes = {r[0]: len(shingles(r[1], width)) for r in rows}
    for r in got:
        assert r["n_shingles"] == sizes[r["doc_id"]] if r["doc_id"] is not None else r["component_id"] is None
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_families_beyond_a_unit_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    monkeypatch.setattr(minhash, "SIGNATURE_ROWS", 8)
    rows = family(5, 90, 120)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(spark, rows), 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_rows_of_one_id_are_nodes_of_their_own(spark):
    a, b = family(8, 1, 60)[0][1], family(9, 1, 60)[0][1]
    rows = [(1, a, "en", "a", 1), (2, a, "en", "a", 1), (2, None, "en", "a", 1), (2, b, "en", "a", 1), (3, b + " more", "en", "a", 1), (3, "", "en", "a", 1), (4, "else", "en", "a", 1)]
    got = near_duplicates(documents(spark, rows), 3, 85).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (2, 2), (3, 2), (3, 3), (4, 4)} and len(got) == len(rows)


def test_empty(spark):
    assert near_duplicates(documents(spark, [])).collect() == []


def test_no_link_at_all(spark):
    rows = [(i, f"w{i} x{i} y{i} z{i} q{i} p{i}", "en", "a", 1) for i in range(20)]
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in near_duplicates(documents(spark, rows)).collect())


def test_shingle_sets_match_their_definition():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "B", "cc", "é", "ß", "x y"]) for _ in range(rng.randint(0, 12))) + rng.choice(["", "\n", "\t\x0b"]) for _ in range(300)]
    for width in (3, 5):
        hashes = shingle_sets([t.encode() for t in texts], width)
        real = [shingles(t, width) for t in texts]
        assert [len(h) for h in hashes] == [len(r) for r in real]
        for i in range(0, 300, 7):
            for j in range(0, 300, 11):
                assert len(np.intersect1d(hashes[i], hashes[j])) == len(real[i] & real[j])


@pytest.mark.parametrize("most", [0, 1 << 30])
def test_overlaps_by_bits_and_by_lookup(monkeypatch, most):
    monkeypatch.setattr(minhash, "BITS_BYTES", most)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in rng.integers(1, 200, 40)]
    shared = minhash.overlaps(sets)
    for i in (0, 7, 39):
        some = [j for j in range(40) if j != i]
        assert shared(i, some).tolist() == [len(np.intersect1d(sets[i], sets[j])) for j in some]


def test_minima_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = np.concatenate((a[:1800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)))
    m = minima([np.unique(a), np.unique(b)])
    assert abs((m[0] == m[1]).mean() - 1800 / 2200) < 0.12


def test_linked_spans_what_full_links_span():
    rng = random.Random(2)
    texts = [r[1].encode() for r in family(7, 50, 100)]
    sets = shingle_sets(texts, 3)
    pairs = linked(sets, np.full(len(sets), 2), 85)
    rng.shuffle(pairs)
    want = brute([(i, t.decode()) for i, t in enumerate(texts)], 3, 85)
    up = list(range(len(texts)))
    for a, b in pairs:
        a, b = up[a], up[b]
        up = [min(a, b) if x in (a, b) else x for x in up]
    groups = lambda m: {frozenset(i for i in range(len(texts)) if m[i] == r) for r in set(m[i] for i in range(len(texts)))}
    assert groups(up) == groups(want)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 301), (301, 300), (300, 301), (None, 5), (7, None)]
    rng = random.Random(3)
    rng.shuffle(edges)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {300: 300, 301: 300}


@pytest.mark.parametrize(("percent", "rows"), [(85, 6), (80, 5)])
def test_signatures_keep_pairs_at_the_bound_and_stop_those_that_share_half(percent, rows):
    rng = np.random.default_rng(9)
    n = 1000

    def pair(share: float):
        common = int(n * share)
        x = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
        return x[:n], x[n - common :] if common else x[n:]

    def passes(jaccard: float, trials: int) -> float:
        share = 2 * jaccard / (1 + jaccard)
        sets = [np.unique(s) for _ in range(trials) for s in pair(share)]
        sigs = minhash.signature(minima(sets, rows))
        return float((minhash.equal_minima(sigs[0::2], sigs[1::2]) >= minhash.enough(2 * sigs.shape[1], percent)).mean())

    assert passes(percent / 100, 300) == 1.0 and passes(0.95, 100) == 1.0
    assert passes(0.5, 300) <= 0.02


@pytest.mark.parametrize("sides", ["one", "two"])
def test_likely_spans_what_all_likely_pairs_span(sides):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (12, 96), dtype=np.uint8)
    sigs = np.concatenate([np.where(rng.random((9, 96)) < rng.choice([0.02, 0.1, 0.2]), rng.integers(0, 256, (9, 96), dtype=np.uint8), b) for b in base])
    side = np.full(len(sigs), 2) if sides == "one" else rng.integers(0, 2, len(sigs))
    up, want = list(range(len(sigs))), list(range(len(sigs)))

    def join(m, i, j):
        a, b = m[i], m[j]
        return [min(a, b) if x in (a, b) else x for x in m]

    for i, j in minhash.likely(sigs, side, 85):
        up = join(up, i, j)
    for i in range(len(sigs)):
        for j in range(i):
            if (side[i] != side[j] or side[i] == 2) and minhash.equal_minima(sigs[i], sigs[j]) >= minhash.enough(192, 85):
                want = join(want, i, j)
    assert up == want and len(set(want)) < len(sigs) - 20


def test_bands_alone_make_no_family(spark):
    """Texts that share about half of their shingles meet by some band, and are no candidates."""
    rng = random.Random(6)
    half = [f"h{k}" for k in range(70)]
    rows = [(i, " ".join(half + [f"w{i}x{rng.randrange(10**6)}" for _ in range(35)]), "en", "a", 1) for i in range(300)]
    sets = shingle_sets([r[1].encode() for r in rows], 3)
    m = minima(sets)
    schema = "rep long, bands binary, signature binary"
    classes = spark.createDataFrame([(r[0], k.tobytes(), s.tobytes()) for r, k, s in zip(rows, minhash.band_keys(m), minhash.signature(m), strict=True)], schema)
    scratch = Scratch(spark, "t")
    keys = Counter(int(k) for row in minhash.band_keys(m) for k in row)
    assert sum(n > 1 for n in keys.values()) > 20
    assert minhash.candidates(classes, 85, 16, scratch).count() <= 30
