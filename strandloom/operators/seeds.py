"""Spaced seeds of reads and references: numpy keys by Arrow batches, both strands, strides, ignore lists."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import bisulfite_keys
from ..functions.masks import Mask, stride
from .layout import spread
from .reference import CHUNK, is_chunked

MAX_READ = 2000
#: Bits of the presence map that a scan may hold: 4^12 keys take 2 MB.
MAP_WEIGHT = 12
_CODE = np.zeros(256, np.int64)
for _i, _b in enumerate(b"ATGC"):
    _CODE[_b] = _i
_COMPLEMENT = np.full(256, ord("N"), np.uint8)
_COMPLEMENT[list(b"ACGTacgt")] = list(b"TGCATGCA")
#: Bases of a sequence whose keys are computed at once.
TILE = 1 << 18


def codes(seq: bytes) -> np.ndarray:
    return _CODE[np.frombuffer(seq, np.uint8)]


def keys_at(code: np.ndarray, offsets: tuple[int, ...], places: np.ndarray) -> np.ndarray:
    """Packed keys of the pattern at each of places."""
    out = np.zeros(len(places), np.int64)
    for i, o in enumerate(offsets):
        out |= code[places + o] << 2 * i
    return out


def reverse_complement(seq: bytes) -> bytes:
    return _COMPLEMENT[np.frombuffer(seq, np.uint8)][::-1].tobytes()


def _seed(mask: Mask, sensitivity: str, both: bool):
    def run(batches):
        for batch in batches:
            ids, strands, voffs, keys = [], [], [], []
            for i, s in zip(batch.column("read_id").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                raw = (s or "").upper().encode("ascii", "replace")
                if len(raw) < mask.span or len(raw) > MAX_READ:
                    continue
                places = np.arange(0, len(raw) - mask.span + 1, stride(sensitivity, len(raw)))
                for strand, own in ((0, raw), (1, reverse_complement(raw)))[: 1 + both]:
                    ids.append(np.full(len(places), i))
                    strands.append(np.full(len(places), strand, np.int32))
                    voffs.append(places.astype(np.int32))
                    keys.append(keys_at(codes(own), mask.offsets, places))
            if ids:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (ids, strands, voffs, keys)], names=["read_id", "strand", "voff", "key"])

    return run


def read_seeds(reads: DataFrame, mask: Mask, sensitivity: str = "medium", bisulfite: bool = False, ignore: DataFrame | None = None) -> DataFrame:
    """(read_id, strand, voff, key): each read's seeds, strand 1 from its reverse complement.

    bisulfite: forward seeds alone, each with its T's read as C or T; the ignore list is held against the
    seed as it is. Reads shorter than the pattern or longer than 2000 have none.
    """
    out = reads.select(F.col("read_id").cast("long").alias("read_id"), "seq").mapInArrow(_seed(mask, sensitivity, not bisulfite), "read_id long, strand int, voff int, key long")
    if ignore is not None:
        out = out.join(ignore.select("key"), "key", "left_anti").select("read_id", "strand", "voff", "key")
    if bisulfite:
        out = out.select("read_id", "strand", "voff", F.explode(bisulfite_keys("key", mask.weight)).alias("key"))
    return out


def _scan(mask: Mask, id_col: str, step: int, presence: bytes | None, skip_zero: bool, in_chunks: bool):
    def bounds(size: int, stretch: int, length: int, back: bool) -> tuple[int, int, int]:
        """A chunk's first place in its contig, and which of its windows it owns: from, to."""
        last = size - mask.span + 1
        if back:
            return length - stretch * CHUNK - size, max(0, last - CHUNK), last
        return stretch * CHUNK, 0, min(CHUNK, last)

    def run(batches):
        have = np.frombuffer(presence, np.uint8) if presence is not None else None
        for batch in batches:
            chunk = zip(*[batch.column(c).to_pylist() for c in ("stretch", "len", "back")], strict=True) if in_chunks else repeat((None,) * 3)
            for i, s, (stretch, length, back) in zip(batch.column(id_col).to_pylist(), batch.column("seq").to_pylist(), chunk, strict=False):
                raw = (s or "").upper().encode("ascii", "replace")
                begin, first, last = bounds(len(raw), stretch, length, back) if in_chunks else (0, 0, len(raw) - mask.span + 1)
                for a in range(first, last, TILE):
                    code = codes(raw[a : a + TILE + mask.span - 1])
                    places = np.arange(-(begin + a) % step, min(TILE, last - a), step)
                    key = keys_at(code, mask.offsets, places)
                    keep = key != 0 if skip_zero else np.ones(len(key), bool)
                    if have is not None:
                        keep &= (have[key >> 3] >> (key & 7).astype(np.uint8)) & 1 > 0
                    if keep.any():
                        places = places[keep] + begin + a
                        yield pa.record_batch([pa.array(np.full(len(places), i)), pa.array(places), pa.array(key[keep])], names=[id_col, "pos", "key"])

    return run


def position_keys(seqs: DataFrame, mask: Mask, id_col: str = "ref_idx", presence: bytes | None = None, skip_zero: bool = True, step: int = 1) -> DataFrame:
    """(id, pos, key) for each place of each sequence. Key 0, which poly-A and N have, is left out (skip_zero).

    seqs: whole sequences (id, seq), or chunks of them. presence: a bit for each key that is looked for; other
    places are dropped inside the scan.
    """
    in_chunks = is_chunked(seqs)
    given = spread(seqs.select(F.col(id_col).cast("long").alias(id_col), "seq", *["stretch", "len", "back"] * in_chunks))
    return given.mapInArrow(_scan(mask, id_col, step, presence, skip_zero, in_chunks), f"{id_col} long, pos long, key long")


def bit_map(values: DataFrame, bits: int) -> bytes:
    """A bit for each number of the one column of values, which are under `bits`.

    Bits are or-ed in Spark by segments; the driver gets segments of 64 KB, as many as `bits` take.
    """
    (col,) = values.columns
    words = values.select((F.col(col) / 64).cast("long").alias("w"), F.expr(f"shiftleft(1L, CAST(`{col}` % 64 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))

    def fill(key, table):
        out = np.zeros(8192, np.int64)
        w = table.column("w").to_numpy()
        out[w % 8192] = table.column("b").to_numpy()
        return pa.table({"s": pa.array([int(w[0] // 8192)]), "bytes": pa.array([out.tobytes()], pa.binary())})

    parts = words.withColumn("s", (F.col("w") / 8192).cast("long")).groupBy("s").applyInArrow(fill, "s long, bytes binary").collect()
    out = bytearray(max(65536, bits // 8))
    for r in parts:
        out[r["s"] * 65536 : r["s"] * 65536 + 65536] = r["bytes"]
    return bytes(out)


def presence_map(keys: DataFrame, mask: Mask) -> bytes | None:
    """A bit for each key of keys, or None for patterns whose map would pass 2 MB."""
    return bit_map(keys.select("key"), 4**mask.weight) if mask.weight <= MAP_WEIGHT else None


def seed_order() -> Column:
    return F.struct(F.col("read_id"), F.col("strand"), F.col("voff"))


def seed_counts(seeds: DataFrame) -> DataFrame:
    """(key, n, least): each key's seeds, and the first of them in order of read, strand and offset."""
    return seeds.groupBy("key").agg(F.count("*").alias("n"), F.min(seed_order()).alias("least"))


def frequency_threshold(counts: DataFrame, keep_percent: int = 99) -> DataFrame:
    """One row: distinct keys, total, max, and the largest count that stays.

    Counts are binned by halves (250 000 bins at most); the bins below which keep_percent of all
    occurrences lie stay whole.
    """
    share = min(max(keep_percent, 90), 100) / 100
    bins = counts.groupBy(F.least(F.floor(F.col("n") / 2), F.lit(249999)).alias("r")).agg(F.sum("n").alias("s"), F.count("*").alias("k"), F.max("n").alias("m"))
    upto = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)  # 250 000 rows at most
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    ranked = bins.select("r", F.sum("s").over(upto).alias("c"), F.sum("s").over(whole).alias("total"), F.sum("k").over(whole).alias("distinct_keys"), F.max("m").over(whole).alias("max_count"))
    return ranked.where(F.col("c") >= F.col("total") * F.lit(share)).groupBy("distinct_keys", "total", "max_count").agg((2 * F.min("r") + 1).alias("threshold"))


def kept_keys(counts: DataFrame, threshold: DataFrame) -> DataFrame:
    """Rows of counts that are no more frequent than the threshold."""
    return counts.join(F.broadcast(threshold.select("threshold")), F.col("n") <= F.col("threshold")).drop("threshold")  # one row


def prune_seeds(seeds: DataFrame, kept: DataFrame) -> DataFrame:
    """Seeds of kept keys, with first: whether no other seed of the key comes before."""
    joined = seeds.join(kept.select("key", "least"), "key")
    return joined.withColumn("first", seed_order() == F.col("least")).drop("least")
