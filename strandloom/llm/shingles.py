"""Word shingles of whole texts as 64-bit hashes, by numpy over blocks of texts."""

from __future__ import annotations

import numpy as np

#: Bytes of text that are hashed at once; one longer text makes a block of its own.
BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_power_cache: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse, modulo 2 to the 64."""
    if n > len(_power_cache.get("p", ())):
        size = max(n, BLOCK + 1)
        made = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 4 * BLOCK:
            return made[0], made[1]
        _power_cache["p"], _power_cache["q"] = made
    return _power_cache["p"], _power_cache["q"]


def blocks(texts: list[bytes], most: int = BLOCK):
    """Runs (from, to) of texts with about `most` bytes each."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts, A-Z as a-z, and each word's text number."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    p, q = powers(len(data) + 1)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    c = np.empty(len(data) + 1, np.uint64)
    c[0] = 0
    np.cumsum(_TABLE[data] * p[: len(data)], out=c[1:])
    h = mix((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return h, np.searchsorted(bounds, starts, side="right")


def shingle_sets(texts: list[bytes], width: int = 3) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's `width`-word shingles; a shorter text is one shingle; no words: empty."""
    out: list[np.ndarray] = []
    for a, b in blocks(texts):
        h, doc = word_hashes(texts[a:b])
        n = len(h)
        if n >= width:
            s = np.zeros(n - width + 1, np.uint64)
            for k in range(width):
                s = mix(s + h[k : n - width + 1 + k])
            same = doc[: n - width + 1] == doc[width - 1 :]
            s, sdoc = s[same], doc[: n - width + 1][same]
        else:
            s, sdoc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.searchsorted(sdoc, np.arange(b - a + 1))
        words = np.searchsorted(doc, np.arange(b - a + 1))
        for i in range(b - a):
            if at[i + 1] > at[i]:
                out.append(np.unique(s[at[i] : at[i + 1]]))
            elif words[i + 1] > words[i]:
                x = np.full(1, words[i + 1] - words[i], np.uint64)
                for w in h[words[i] : words[i + 1]]:
                    x = mix(x + w)
                out.append(x)
            else:
                out.append(np.zeros(0, np.uint64))
    return out
