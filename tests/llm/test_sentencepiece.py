import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm.sentencepiece import MODEL, Sampler, decode, encode

from .cases import EDGES, documents, ids


@pytest.fixture(scope="module")
def sampler():
    return Sampler()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_decoding_is_lossless(sampler, t):
    for key in (0, 7):
        (got,) = sampler.sample([t], [key])
        assert sampler.decode(got.tolist()) == t


@pytest.mark.parametrize("t", ["", " ", "   ", "  a  b ", "▁", "▁ ▁a", "\n\n", "日本語 text", "😀" * 3, "a" * 3000, "\u0000", "x▁y"])
def test_hard_texts(sampler, t):
    (got,) = sampler.sample([t], [3])
    assert sampler.decode(got.tolist()) == t


@pytest.mark.parametrize("word", ["hello", "thet", "ab"])
def test_draws_follow_the_lattice(sampler, word):
    """Frequencies of segmentations against all segmentations with their probabilities."""
    pieces = {b.decode(): i for i, b in enumerate(sampler.v.bytes_of) if b and i >= 259}
    w = " " + word

    def all_of(s):
        if not s:
            yield (), 0.0
        for n in range(1, len(s) + 1):
            if s[:n] in pieces:
                for rest, p in all_of(s[n:]):
                    yield (s[:n], *rest), p + sampler.v.logp[pieces[s[:n]]]

    weights = {seg: math.exp(p) for seg, p in all_of(w)}
    total = sum(weights.values())
    n = 30_000
    got = Counter(tuple(sampler.v.bytes_of[i].decode() for i in x) for x in sampler.sample([word] * n, list(range(n))))
    for seg, p in weights.items():
        p /= total
        assert abs(got[seg] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_draws_depend_on_key_place_and_seed_alone():
    texts = ["the quick brown fox jumps over the lazy dog " * 5] * 6
    keys = list(range(6))
    a = Sampler().sample(texts, keys)
    s = Sampler()
    s.sample(["other words that come first", *texts[:2]], [1, 2, 3])
    b = [s.sample([t], [k])[0] for t, k in zip(texts, keys, strict=True)]
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
    assert len({tuple(x) for x in a}) > 3
    assert any(not np.array_equal(x, y) for x, y in zip(a, Sampler(seed=1).sample(texts, keys), strict=True))


def test_words_are_dropped_when_there_are_many(monkeypatch):
    from strandloom.llm import sentencepiece as m

    texts = [f"word{i} thing{i}" for i in range(50)]
    a = Sampler().sample(texts, list(range(50)))
    monkeypatch.setattr(m, "KEPT_WORDS", 10)
    monkeypatch.setattr(m, "BUILD_CHARS", 40)
    s = Sampler()
    b = [s.sample([t], [i])[0] for i, t in enumerate(texts)]
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_rows(spark):
    docs = documents(spark)
    out = encode(docs.repartition(3)).cache()
    rows = out.collect()
    assert ids(rows) == ids(EDGES) and all(r["lossless"] for r in rows)
    texts = {r[0]: r[1] for r in EDGES}
    assert all((r["ids"] is None) == (texts[r["doc_id"]] is None) and r["n_pieces"] == len(r["ids"] or []) for r in rows)
    assert {(r["doc_id"], r["text"]) for r in decode(out).collect()} == {(r[0], r[1]) for r in EDGES}
    again = {(r["doc_id"], tuple(r["ids"] or ())) for r in encode(docs.coalesce(1)).collect()}
    assert again == {(r["doc_id"], tuple(r["ids"] or ())) for r in rows}
    assert encode(documents(spark, [])).collect() == []


def test_ids_are_those_of_the_library(sampler):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=MODEL)
    t = "Some words, naïve 日本語 😀 and 12.5 numbers"
    (got,) = sampler.sample([t], [1])
    assert sp.decode(got.tolist()) == t


def test_orders_of_edges_are_one(monkeypatch):
    """Words too long for packed places are ordered by columns; both orders give the same segmentations."""
    from strandloom.llm import sentencepiece as m

    texts = ["a" * 40_000 + "bcd" * 5000, "the quick brown fox", "日本語" * 900, "x" * 3 + " y"]
    a = m.Sampler().sample(texts, [1, 2, 3, 4])
    monkeypatch.setattr(m, "PACKED", 0)
    assert all(np.array_equal(x, y) for x, y in zip(a, m.Sampler().sample(texts, [1, 2, 3, 4]), strict=True))
    assert (m.PACKED or 1 << 22) << 41 > 0 and ((1 << 22) << 32 | 1 << 31) << 8 < 1 << 63


def test_a_word_of_a_million_characters(sampler):
    t = "ab" * 500_000
    (got,) = sampler.sample([t], [5])
    assert sampler.decode(got.tolist()) == t
    sampler.clear()
