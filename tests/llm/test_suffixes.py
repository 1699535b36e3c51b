import hashlib
import random

import numpy as np
import pytest

from strandloom.llm import suffixes
from strandloom.llm.blobs import gaps, pack, unpack
from strandloom.llm.suffixes import multikey_sort, remove_repeats, symbols, tokens

from .cases import EDGES, documents, ids, text


def brute(rows, span: int) -> list:
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    first: dict[bytes, int] = {}
    for i, t in data:
        if i is not None:
            for p in range(len(t) - span + 1):
                w = t[p : p + span]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        if i is not None:
            for p in range(len(t) - span + 1):
                if first[t[p : p + span]] < i:
                    gone[p : p + span] = b"\1" * span
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(t)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def made(seed: int, n: int) -> list:
    rng = random.Random(seed)
    passages = [text(rng.randint(8, 25), 100 + i) for i in range(6)] + ["ab" * 60, "z" * 130, "é" * 40]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else text(rng.randint(1, 12), 1000 * seed + 10 * i + k) for k in range(rng.randint(1, 6))]
        if rng.random() < 0.3:
            p = parts[0]
            parts[0] = p[rng.randrange(len(p)) :]
        rows.append((rng.randrange(10_000), rng.choice([" ", ""]).join(parts), "en", "a", 1))
    return rows


def canon(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("hot", [200_000, 3, 0])
@pytest.mark.parametrize("span", [50, 31])
def test_against_all_strings(spark, monkeypatch, span, hot):
    monkeypatch.setattr(suffixes, "BUCKET_SUFFIXES", 40)
    rows = made(span + hot % 7, 60) + [r for r in EDGES if r[0] != 6]
    got = remove_repeats(documents(spark, rows).repartition(5), span, True, hot).collect()
    assert canon((*r[:5], bytes(r[5])) for r in got) == canon(brute(rows, span))


def test_many_documents_and_spans(spark):
    rows = made(9, 250)
    got = remove_repeats(documents(spark, rows).repartition(3)).collect()
    assert canon(r[:5] for r in got) == canon(r[:5] for r in brute(rows, 50))


@pytest.mark.parametrize("span", [151, 176, 200])
def test_long_spans(spark, span):
    """Runs of the longest spans that are admitted take no byte of their neighbours."""
    passages = [text(80, 300 + i) for i in range(4)]
    rows = [(i, f"{text(9, 400 + i)} {passages[i % 4][i // 4 * 7 :]} {text(60, 500 + i)}", "en", "a", 1) for i in range(24)]
    got = remove_repeats(documents(spark, rows).coalesce(1), span, True).collect()
    assert canon((*r[:5], bytes(r[5])) for r in got) == canon(brute(rows, span)) and any(r["n_removed"] for r in got)


@pytest.mark.parametrize("hot", [200_000, 0])
def test_null_id_that_shares_a_passage(spark, hot):
    """It counts for no other row: the least known document keeps the passage."""
    passage = text(20, 1)
    rows = [(i, f"{text(4, 10 + k)} {passage} {text(4, 20 + k)}", "en", "a", 1) for k, i in enumerate([None, 5, 7])]
    got = remove_repeats(documents(spark, rows).coalesce(1), 50, True, hot).collect()
    assert canon((*r[:5], bytes(r[5])) for r in got) == canon(brute(rows, 50))
    assert {r["doc_id"]: r["n_removed"] > 0 for r in got} == {None: False, 5: False, 7: True}


def test_edges_and_empty(spark):
    got = remove_repeats(documents(spark)).collect()
    assert ids(got) == ids(EDGES)
    by = {(r["doc_id"], r["n_removed"]) for r in got}
    n = len(EDGES[0][1])
    assert {(1, 0), (2, n), (9, n), (3, 0), (4, 0)} <= by
    assert remove_repeats(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        remove_repeats(documents(spark), span=10)


def test_tokens_are_the_same_in_equal_strings(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    data[3000:3500] = data[1000:1500]
    whole = tokens(data, np.array([2000, 5000]), 50)
    monkeypatch.setattr(suffixes, "TILE", 400)
    tiled = tokens(data, np.array([2000, 5000]), 50)
    assert all((a == b).all() for a, b in zip(whole[:3], tiled[:3], strict=True))
    p, lo, hi, _ = whole
    windows = [w for a, b in zip(lo, hi, strict=True) for w in range(a, b + 1)]
    assert windows == [*range(2000 - 49), *range(2000, 5000 - 49)]
    assert all(a <= q <= b + 26 and q >= b for q, a, b in zip(p, lo, hi, strict=True))
    inner = {q - 1000 for q, a, b in zip(p, lo, hi, strict=True) if a >= 1000 and b < 1450}
    assert inner <= {q - 3000 for q in p}


def test_multikey_sort():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 2, (500, 20)).astype(np.uint8)
    rows[250:] = rows[:250]
    order, new = multikey_sort(symbols(rows))
    in_order = [rows[i].tobytes() for i in order]
    assert in_order == sorted(in_order)
    assert [bool(x) for x in new] == [i == 0 or in_order[i] != in_order[i - 1] for i in range(500)]


def test_packing():
    arrays = [np.arange(10, dtype=np.int64), np.zeros(0, np.uint32), np.ones((3, 4), np.uint8), np.array([5], np.uint16)]
    for a, b in zip(arrays, unpack(pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and a.shape == b.shape and (a == b).all()
    x = np.array([3, 9, 9, 40], np.uint64)
    assert (np.cumsum(gaps(x), dtype=np.uint64) == x).all()


@pytest.mark.parametrize("kind", ["few", "many", "equal", "runs"])
def test_multikey_quicksort_of_many_rows(kind):
    rng = np.random.default_rng(2)
    n = 3 * suffixes.SMALL + 77
    rows = {
        "few": rng.integers(0, 3, (n, 5)),
        "many": rng.integers(0, 1 << 62, (n, 3)),
        "equal": np.full((n, 4), 7),
        "runs": np.repeat(rng.integers(0, 4, (n // 50 + 1, 6)), 50, axis=0)[:n],
    }[kind].astype(np.uint64)
    order, new = multikey_sort(rows)
    want = np.lexsort(rows.T[::-1])
    assert (order == want).all()
    assert (new == np.concatenate(([True], (rows[want][1:] != rows[want][:-1]).any(1)))).all()
    assert multikey_sort(rows[:0])[0].tolist() == []
