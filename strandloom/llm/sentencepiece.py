"""Sampled SentencePiece segmentations by forward filtering and backward sampling; lossless decoding.

A text's lattice falls apart where no piece can cross, before each run of spaces, so it is built and
filtered once for each distinct word and sampled for all of its occurrences together.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import lean_memory
from .common import spread
from .shingles import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Exponent of piece probabilities: 1 samples by the model, more comes nearer to the best segmentation.
ALPHA = 0.5
#: Characters of text that are sampled at once, and distinct words that a worker keeps.
BLOCK_CHARS, KEPT_WORDS = 1 << 20, 250_000
#: Characters of a lattice that is built in one go; more words take more goes.
BUILD_CHARS = 1 << 17
#: Characters of a word from which on an edge's place no longer fits into one number.
PACKED = 1 << 22
#: Values that a draw may take; probabilities are rounded to that many parts.
DRAWS = 1 << 24
_WORD = re.compile(" *[^ ]+| +")


class Vocabulary:
    """Pieces of a model as a trie in sorted arrays; a space stands for the model's space mark."""

    def __init__(self, path: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, np.int64)
        plain: list[tuple[str, int]] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                own = piece.replace("▁", " ")
                self.bytes_of[i] = own.encode()
                plain.append((own, i))
        if any(re.search("[^ ] ", p) for p, _ in plain):
            raise ValueError("a piece crosses a word's bounds")
        if max(len(p) for p, _ in plain) > 255:
            raise ValueError("a piece is too long")
        if (self.byte_id < 0).any():
            raise ValueError("the model has no bytes to fall back on")
        # a merge's rank is all that such a model knows; probabilities fall with the rank as words' do
        rank = np.array([min(-sp.get_score(i), n) for i in range(n)])
        weight = 1 / (rank + 10)
        self.logp = alpha * (np.log(weight) - np.log(weight.sum()))
        self.byte_logp = alpha * np.log(1 / (4.0 * n))
        kids: dict[tuple[int, int], int] = {}
        piece_at: dict[int, int] = {}
        for own, i in plain:
            state = 0
            for c in own:
                state = kids.setdefault((state, ord(c)), len(kids) + 1)
            piece_at[state] = i
        self.depth = max((len(p) for p, _ in plain), default=1)
        edge = np.array([s << 21 | c for s, c in kids], np.int64)
        order = np.argsort(edge)
        self.edge, self.kid = edge[order], np.array(list(kids.values()), np.int64)[order]
        self.begin = np.zeros(0x110000, np.int32)  # the state after a first character, 0 if no piece has it
        for (state, c), kid in kids.items():
            if state == 0:
                self.begin[c] = kid
        self.piece = np.full(len(kids) + 1, -1, np.int64)
        self.piece[list(piece_at)] = list(piece_at.values())

    def edges(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of all pieces in a row of characters; left: characters up to a word's end.

        A character that is no piece has an edge of its own, with piece -1.
        """
        first = self.begin[chars].astype(np.int64)
        at = np.flatnonzero(first)
        state, out = first[at], []
        single = np.zeros(len(chars), bool)
        for n in range(1, self.depth + 1):
            if n > 1:
                ask = state << 21 | chars[at + n - 1]
                k = np.minimum(np.searchsorted(self.edge, ask), len(self.edge) - 1)
                ok = self.edge[k] == ask
                at, state = at[ok], self.kid[k[ok]]
            piece = self.piece[state]
            has = piece >= 0
            out.append((at[has], np.full(has.sum(), n), piece[has]))
            if n == 1:
                single[at[has]] = True
            more = left[at] > n
            at, state = at[more], state[more]
            if not len(at):
                break
        bare = np.flatnonzero(~single)
        out.append((bare, np.ones(len(bare), np.int64), np.full(len(bare), -1)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Sampler:
    """Samples segmentations of texts; keeps the filtered lattices of words it has met."""

    def __init__(self, path: str = MODEL, alpha: float = ALPHA, seed: int = 0):
        self.v, self.seed = Vocabulary(path, alpha), seed
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.first = np.zeros(1024, np.int64)  # node of each word's start
        self.last = np.zeros(1024, np.int64)
        self.enter = np.zeros(1 << 16, np.int32)  # each node's first edge, the likeliest
        self.upto = np.zeros(1 << 16, np.int32)  # an edge's share of DRAWS and that of its node's edges before it
        self.back = np.zeros(1 << 16, np.int32)  # where the edge comes from
        self.what = np.zeros(1 << 16, np.int32)  # its piece, or -1 - character
        self.n_edges = self.n_nodes = 0

    def _grow(self, name: str, size: int) -> None:
        old = getattr(self, name)
        if size > len(old):
            new = np.zeros(max(size, len(old) * 5 // 4), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def build(self, words: list[str]) -> None:
        """Adds the filtered lattices of new words."""
        sizes = np.array([len(w) for w in words])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(chars))
        start, size, piece = self.v.edges(chars, left)
        word = np.searchsorted(ends, start, side="right")
        node = start + word + size  # a word of n characters has n + 1 nodes
        weight = np.where(piece >= 0, self.v.logp[piece], 0.0)
        bare = piece < 0
        if bare.any():
            c = chars[start[bare]]
            weight[bare] = self.v.byte_logp * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
            piece[bare] = -1 - c
        depth = node - (ends - sizes + np.arange(len(words)))[word]
        # one order for a word, wherever it stands
        by = np.argsort((depth << 32 | node) << 8 | size) if sizes.max(initial=0) < PACKED else np.lexsort((size, node, depth))
        start, size, piece, node, weight, depth = (x[by] for x in (start, size, piece, node, weight, depth))
        source = node - size
        alpha = np.zeros(len(chars) + len(words))
        share = np.empty(len(node))
        cut = np.append(np.flatnonzero(np.diff(depth, prepend=0)), len(depth))
        for a, b in zip(cut[:-1], cut[1:], strict=True):  # forward filtering, one place of all words at a time
            value = alpha[source[a:b]] + weight[a:b]
            first = np.flatnonzero(np.diff(node[a:b], prepend=-1))
            count = np.diff(np.append(first, b - a))
            top = np.repeat(np.maximum.reduceat(value, first), count)
            e = np.exp(value - top)
            total = np.add.reduceat(e, first)
            alpha[node[a:b][first]] = top[first] + np.log(total)
            share[a:b] = e / np.repeat(total, count)
        by = np.argsort(node + (1 - share) / 2 + (node - source) * 1e-9)  # of equal shares the shorter piece first
        node, source, piece, share = node[by], source[by], piece[by], share[by]
        fresh = np.flatnonzero(np.diff(node, prepend=-1))
        part = np.round(share * DRAWS).astype(np.int64)
        run = np.cumsum(part)
        upto = (run - np.repeat(run[fresh] - part[fresh], np.diff(np.append(fresh, len(node))))).astype(np.int32)
        upto[np.append(fresh[1:], len(node)) - 1] = DRAWS
        n, w = self.n_edges, len(self.words)
        for name in ("upto", "back", "what"):
            self._grow(name, n + len(node))
        for name in ("first", "last"):
            self._grow(name, w + len(words))
        self._grow("enter", self.n_nodes + len(chars) + len(words))
        self.enter[self.n_nodes + node[fresh]] = n + fresh
        self.upto[n : n + len(node)] = upto
        self.back[n : n + len(node)] = self.n_nodes + source
        self.what[n : n + len(node)] = piece
        self.first[w : w + len(words)] = self.n_nodes + ends - sizes + np.arange(len(words))
        self.last[w : w + len(words)] = self.n_nodes + ends + np.arange(len(words))
        self.n_edges += len(node)
        self.n_nodes += len(chars) + len(words)
        for i, x in enumerate(words):
            self.words[x] = w + i

    def sample(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """The ids of a sampled segmentation of each text; the same for the same text, key and seed."""
        if len(self.words) > KEPT_WORDS:
            self.clear()
        split = [_WORD.findall(" " + t) if t else [] for t in texts]
        flat = list(chain.from_iterable(split))
        fresh = list(set(flat).difference(self.words))
        at = 0
        while at < len(fresh):
            end, size = at, 0
            while end < len(fresh) and (end == at or size + len(fresh[end]) <= BUILD_CHARS):
                size += len(fresh[end])
                end += 1
            self.build(fresh[at:end])
            at = end
        counts = np.array([len(ws) for ws in split])
        which = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        row = np.repeat(np.arange(len(texts)), counts)
        first, node = self.first[which], self.last[which]
        chars = node - first
        begin = np.cumsum(chars) - chars
        begin -= np.repeat(begin[np.minimum(np.cumsum(counts) - counts, len(begin) - 1)] if len(begin) else begin, counts) if len(begin) else 0
        seeds = mix(np.array([k & (1 << 64) - 1 for k in keys], np.uint64) + mix(np.full(1, self.seed, np.uint64)))[row]
        own = np.arange(len(which))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        used = np.zeros(len(which), np.int64)
        while len(own):  # backward sampling, one piece of all words at a time
            place = (begin[own] + node - first[own]).astype(np.uint64)
            u = (mix(seeds[own] ^ (place * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(40)).astype(np.int32)
            e = self.enter[node]
            on = np.flatnonzero(u >= self.upto[e])
            while len(on):
                e[on] += 1
                on = on[u[on] >= self.upto[e[on]]]
            steps.append((own, self.what[e]))
            used[own] += 1
            node = self.back[e]
            more = node > first[own]
            own, node = own[more], node[more]
        total = int(used.sum())
        stop = np.cumsum(used)
        ids = np.empty(total, np.int64)
        for n, (own, what) in enumerate(steps):
            ids[stop[own] - 1 - n] = what
        bounds = np.concatenate(([0], np.cumsum(np.bincount(row, used, minlength=len(texts)).astype(np.int64))))
        if (ids < 0).any():  # characters that are no pieces become bytes
            bare = np.flatnonzero(ids < 0)
            raw = [self.v.byte_id[np.frombuffer(chr(-1 - c).encode("utf-8", "surrogatepass"), np.uint8)] for c in ids[bare]]
            width = np.ones(total, np.int64)
            width[bare] = [len(r) for r in raw]
            place = np.cumsum(width) - width
            wide = np.empty(int(width.sum()), np.int64)
            wide[place] = ids
            for p, r in zip(place[bare], raw, strict=True):
                wide[p : p + len(r)] = r
            ids, bounds = wide, np.append(place, len(wide))[bounds]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def decode(self, ids) -> str:
        """The text of which ids are a segmentation."""
        of = self.v.bytes_of
        return b"".join([of[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


def _encode(path: str, alpha: float, seed: int):
    def run(batches):
        lean_memory()
        sampler = Sampler(path, alpha, seed)
        for batch in batches:
            keys, texts = batch.column("doc_id"), batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.cumsum(sizes) // BLOCK_CHARS
            cut = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(sizes)) if len(sizes) else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                text = texts.slice(a, b - a).to_pylist()
                ids = sampler.sample([t or "" for t in text], [k or 0 for k in keys.slice(a, b - a).to_pylist()])
                same = [t is None or sampler.decode(i.tolist()) == t for t, i in zip(text, ids, strict=True)]
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                none = np.array([t is None for t in text])
                flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(none, False)), flat)
                yield pa.record_batch([keys.slice(a, b - a), pa.array([len(i) for i in ids], pa.int64()), lists, pa.array(same)], names=["doc_id", "n_pieces", "ids", "lossless"])

    return run


def encode(docs: DataFrame, model: str = MODEL, alpha: float = ALPHA, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids and lossless for each row: a segmentation drawn from the lattice of the text's pieces.

    Draws depend on the row's id, the place in the text and seed alone, so results are the same however
    rows are dealt to tasks. Characters that are no pieces become byte pieces; so does the model's own
    space mark in a text, which decodes to itself. Spaces are kept as they are. lossless tells whether
    the ids, decoded, are the text (always, as tests show).

    Null text: null ids, 0 pieces, lossless. Empty text: no ids. Rows of one id and text get one
    segmentation; null ids draw as id 0. Other columns are ignored. An empty table gives an empty result.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return spread(given).mapInArrow(_encode(model, alpha, seed), "doc_id long, n_pieces long, ids array<int>, lossless boolean")


def _decode(path: str):
    def run(batches):
        of = Vocabulary(path, 1.0).bytes_of
        for batch in batches:
            texts = [None if ids is None else b"".join([of[i] for i in ids])[1:].decode() for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text for each row of doc_id and ids.

    Null ids give null, no ids empty text. Repeated rows and null doc_ids are kept. Other columns, whatever their names,
    are ignored. An empty table gives an empty result.
    """
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model), "doc_id long, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
SQL: dict[str, str] = {}
