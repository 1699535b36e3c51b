"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.seeds import bit_map
from .blobs import lean_memory
from .common import Scratch, salted_join, spread
from .shingles import blocks, mix

#: Edits allowed for each byte of an item, after both sides are normalised.
ERROR_RATE = 0.08
#: Numbers of first bytes by which pieces are looked for: each by the most of these that it has.
LEADS = (1, 2, 3, 4, 5, 6, 8, 11, 16)
#: Bits of a map of pieces, at most, and bytes of items that share a map.
MAP_BITS, BLOCK_BYTES = 1 << 27, 64 << 20
#: Bits of a map for each piece, as long as it is no larger: nearly all texts without a piece then meet none.
SPARSE = 1 << 14
#: Items whose pieces a worker keeps.
KEPT_ITEMS = 20_000

# all ASCII but letters and digits becomes a space, one byte for one
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normal(text: str) -> bytes:
    """Lower case, every run of ASCII that is no letter or digit as one space."""
    return b" ".join(text.lower().encode().translate(_TABLE).split())


def places(text: str) -> list[int]:
    """For each byte of normal(text) the code point it comes from."""
    out, gap = [], False
    for i, c in enumerate(text):
        for b in c.lower().encode().translate(_TABLE):
            if b in b" \t\n\r\x0b\x0c":
                gap = bool(out)
            else:
                if gap:
                    out.append(i)
                    gap = False
                out.append(i)
    return out


def pieces(item: bytes, rate: float) -> tuple[int, list[tuple[int, bytes]]]:
    """The error budget, and budget + 1 pieces (offset, bytes) that make up the item.

    At most budget edits leave at least one of the pieces as it is.
    """
    budget = int(len(item) * rate)
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return budget, [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def masks(pattern: bytes) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distances(m: int, peq: dict[int, int], text: bytes, free_start: bool = True) -> Iterator[int]:
    """The least edit distance of the pattern to a part of text that ends at each place.

    Myers' recurrence on whole columns as one integer of m bits. Without free_start the part is the
    whole text up to there.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1) | (not free_start)
        mh <<= 1
        pv = (mh | (full & ~(xv | ph))) & full
        mv = ph & xv & full
        yield score


def occurrences(text: bytes, item: bytes, budget: int, starts: list[int]) -> list[tuple[int, int, int]]:
    """(distance, start, end) of the item near places where it may start, apart from each other."""
    m, k = len(item), budget
    merged: list[list[int]] = []
    for a, b in sorted((max(0, s - k), min(len(text), s + m + k)) for s in starts):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    forth, back = masks(item), masks(item[::-1])
    out: list[tuple[int, int, int]] = []
    for a, b in merged:
        best: list[tuple[int, int]] = []  # of each run of ends within the budget, the best
        last = -2
        for i, d in enumerate(distances(m, forth, text[a:b])):
            if d <= k:
                if i == last + 1 and i - best[-1][1] < m:
                    best[-1] = min(best[-1], (d, i), key=lambda x: x[0])
                else:
                    best.append((d, i))
                last = i
        for d, i in best:
            end = a + i + 1
            left = text[max(0, end - m - k) : end][::-1]
            size = min(range(len(left)), key=lambda j, s=list(distances(m, back, left, False)): (s[j], abs(j + 1 - m)))
            found = (d, end - size - 1, end)
            if out and found[1] < out[-1][2]:  # one occurrence, seen at two ends
                out[-1] = min(out[-1], found, key=lambda x: x[0])
            else:
                out.append(found)
    return out


class Finder:
    """Occurrences of some items in one text: the same search without Spark."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float):
        self.items = [(item, *pieces(item, rate)) for _, item in items]

    def find(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item's number, distance, start, end)."""
        out = []
        for n, (item, budget, parts) in enumerate(self.items):
            starts = [i - at for at, p in parts for i in _places_of(p, text)]
            out += [(n, *x) for x in occurrences(text, item, budget, starts)]
        return out


def _places_of(piece: bytes, text: bytes) -> Iterator[int]:
    i = text.find(piece)
    while i >= 0:
        yield i
        i = text.find(piece, i + 1)


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` bytes, 16 at most, of an array of bytes."""
    x, size = data.astype(np.uint64), 1
    while 2 * size <= min(width, 8):
        x = x[:-size] | (x[size:] << np.uint64(8 * size))
        size *= 2
    n = max(0, len(data) - width + 1)
    return mix(x[:n] * np.uint64(0x9E3779B97F4A7C15) + x[width - size : width - size + n] + np.uint64(width))


def lead(size: int) -> int:
    return max(w for w in LEADS if w <= size)


def _normalised(batches):
    for batch in batches:
        rows = [(i, n) for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t and (n := normal(t))]
        yield pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.binary())], names=["item_id", "item"])


def _pieces(rate: float):
    """A row for each piece of each item: the hash of its first bytes, how many these are, and its place in the item."""

    def run(batches):
        for batch in batches:
            for item in batch.column("item").to_pylist():
                own = [(p[: lead(len(p))], at) for at, p in pieces(item, rate)[1]]
                grams = [int(window_hashes(np.frombuffer(p, np.uint8), len(p))[0].view(np.int64)) for p, _ in own]
                n = len(own)
                yield pa.record_batch([pa.array(grams, pa.int64()), pa.array([len(p) for p, _ in own], pa.int32()), pa.array([at for _, at in own], pa.int32()), pa.array([item] * n, pa.binary())], names=["gram", "width", "at", "item"])

    return run


def _scan(have: bytes, widths: list[int]):
    """Rows whose text has some piece's first bytes, as the map tells, with what was met where in the normalised text."""
    bits = len(have) * 8

    def run(batches):
        lean_memory()
        present = np.frombuffer(have, np.uint8)
        base, n = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            plain = [normal(t) if t else b"" for t in texts]
            for a, b in blocks(plain):
                data = np.frombuffer(b"\0".join(plain[a:b]) + b"\0", np.uint8)  # no normalised text has this byte
                ends = np.cumsum([len(t) + 1 for t in plain[a:b]])
                grams, spots = [], []
                for w in widths:
                    h = window_hashes(data, w)
                    slot = h & np.uint64(bits - 1)
                    at = np.flatnonzero((present[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
                    grams.append(h[at])
                    spots.append(at)
                gram, spot = np.concatenate(grams).view(np.int64), np.concatenate(spots)
                order = np.argsort(spot, kind="stable")
                gram, spot = gram[order], spot[order]
                doc = np.searchsorted(ends, spot, side="right")
                some = np.unique(doc)
                if len(some):
                    begin = np.concatenate(([0], ends[:-1]))
                    lists = np.append(np.searchsorted(doc, some), len(doc)).astype(np.int32)
                    cols = [pa.array(base + n + np.arange(len(some))), pa.array([ids[a + i] for i in some], pa.int64()), pa.array([texts[a + i] for i in some], pa.string())]
                    cols += [pa.ListArray.from_arrays(pa.array(lists), pa.array(x)) for x in (gram, spot - begin[doc])]
                    n += len(some)
                    yield pa.record_batch(cols, names=["row", "doc_id", "text", "grams", "spots"])

    return run


def _verify(rate: float):
    """Of rows with the pieces that may stand in them: the items that do."""

    def run(batches):
        lean_memory()
        made: dict[bytes, tuple[int, dict[int, bytes]]] = {}
        for batch in batches:
            out = []
            for i, t, hits in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "hits")], strict=True):
                text, starts = normal(t), {}
                for h in hits:
                    item = h["item"]
                    if item not in made:
                        if len(made) > KEPT_ITEMS:
                            made.clear()
                        budget, parts = pieces(item, rate)
                        made[item] = budget, dict(parts)
                    piece = made[item][1][h["at"]]
                    if text[h["spot"] : h["spot"] + len(piece)] == piece:
                        starts.setdefault(item, []).append(h["spot"] - h["at"])
                found = [(item, *x) for item, own in sorted(starts.items()) for x in occurrences(text, item, (made.get(item) or pieces(item, rate))[0], own)]
                if found:
                    at = places(t)
                    out += [(i, item, d, len(item), at[a], at[b - 1] + 1) for item, d, a, b in found]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item", "distance", "item_bytes", "start", "end"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, distance, item_bytes, start, end for each place where a row holds an item.

    Both texts are normalised; an item is found where its edit distance to a part of the text is at most
    rate * its bytes. start and end are code points of the row's own text. Of places of one item that
    overlap the best one is returned.

    Pieces are looked for by their first bytes: a map of bits, MAP_BITS at most, tells a scan where some may stand,
    and what it finds is joined with the pieces, a frequent one's places dealt to sub-groups. Rows that meet pieces
    are verified. Items never pass through the driver. Beyond block_bytes of items the map would fill up; items are
    dealt by hash to several maps, each of which takes a pass over the rows.

    Null or empty texts hold nothing; items that are null or empty when normalised are left out. An item of under
    1 / rate bytes has a budget of 0: it is found wherever its bytes stand, inside of longer words too. Repeated
    rows and items each give rows. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    given = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    named = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(_normalised, "item_id long, item binary")
    named = scratch.table(named, "items")
    distinct = named.select("item").distinct()
    parts = scratch.table(distinct.mapInArrow(_pieces(rate), "gram long, width int, at int, item binary"), "pieces")
    size = distinct.agg(F.sum(F.length("item"))).first()[0]
    passes = -(-(size or 0) // block_bytes)
    out = []
    for k in range(passes):
        own = parts.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k)
        known = own.agg(F.count("*").alias("n"), F.collect_set("width").alias("widths")).first()  # a width of LEADS
        if not known["n"]:
            continue
        bits = min(MAP_BITS, max(1 << 19, 1 << (SPARSE * known["n"]).bit_length()))
        have = bit_map(own.select(F.col("gram").bitwiseAND(bits - 1).alias("slot")), bits)
        schema = "row long, doc_id long, text string, grams array<long>, spots array<long>"
        suspects = scratch.table(given.mapInArrow(_scan(have, sorted(known["widths"])), schema), "suspects")
        met = suspects.select("row", F.explode(F.arrays_zip("grams", "spots")).alias("x")).select("row", F.col("x.grams").alias("gram"), F.col("x.spots").alias("spot"))
        hits = salted_join(met, own.select("gram", "at", "item"), ["gram"], ["row", "spot"])
        hits = hits.groupBy("row").agg(F.collect_list(F.struct("item", "at", "spot")).alias("hits"))  # of one text
        found = suspects.select("row", "doc_id", "text").join(hits, "row").select("doc_id", "text", "hits")
        out.append(scratch.table(found.mapInArrow(_verify(rate), "doc_id long, item binary, distance int, item_bytes int, start long, end long"), "places"))
        scratch.drop(suspects)
    columns = ["doc_id", "item_id", "distance", "item_bytes", "start", "end"]
    if not out:
        return spark.createDataFrame([], "doc_id long, item_id long, distance int, item_bytes int, start long, end long")
    return salted_join(reduce(DataFrame.unionByName, out), named, ["item"], ["doc_id", "start"]).select(*columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in all documents that hold a benchmark item with few edits."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op5_decontamination": op5_decontamination}
SQL: dict[str, str] = {}
