"""K-mer frequencies over both strands, their statistics, and ignore lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import key_kmer
from ..functions.masks import Mask
from .layout import spread
from .reference import CHUNK, is_chunked
from .seeds import TILE, _CODE, keys_at

LARGEST = 4294967295
_BASE = np.zeros(256, bool)
_BASE[list(b"ACGT")] = True


def _count(mask: Mask, fold_a: bool):
    """Counts within a task, so that few rows are shuffled; emptied at a bounded size."""
    reverse = tuple(mask.span - 1 - o for o in mask.offsets)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            k, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            u, back = np.unique(k, return_inverse=True)
            return u, np.bincount(back, n, minlength=len(u)).astype(np.int64)

        for batch in batches:
            for s in batch.column("seq").to_pylist():
                raw = s or ""
                raw = (raw.upper() if fold_a else raw.translate({c: c - 32 for c in range(98, 123)})).encode("ascii", "replace")
                for a in range(0, len(raw) - mask.span + 1, TILE):
                    data = np.frombuffer(raw, np.uint8)[a : a + TILE + mask.span - 1]
                    code = _CODE[data]
                    places = np.arange(len(data) - mask.span + 1)
                    # every base of the window, not the sampled ones alone, must be known
                    bad = np.concatenate(([0], np.cumsum(~_BASE[data])))
                    places = places[bad[mask.span :] == bad[: len(bad) - mask.span]]
                    if len(places):
                        both = np.concatenate((keys_at(code, mask.offsets, places), keys_at(_swap(code), reverse, places)))
                        held.append(np.unique(both, return_counts=True))
                        size += len(held[-1][0])
                        if size > 4_000_000:
                            u, n = merged()
                            held, size = [(u, n)], len(u)
                            if size > 2_000_000:
                                yield pa.record_batch([pa.array(u), pa.array(n)], names=["key", "n"])
                                held, size = [], 0
        if held:
            u, n = merged()
            yield pa.record_batch([pa.array(u), pa.array(n)], names=["key", "n"])

    return run


def _swap(code: np.ndarray) -> np.ndarray:
    """Codes of complements: A and T are 0 and 1, G and C 2 and 3."""
    return code ^ 1


def kmer_frequencies(seqs: DataFrame, mask: Mask, fold_a: bool = True) -> DataFrame:
    """(key, kmer, freq): how often each key is met, over every window and its reverse complement.

    Windows with other letters than bases count nothing, and none crosses sequences. Counts stop at
    2^32 - 1. fold_a False: a lower-case a is no base, all other lower-case letters are. seqs: whole sequences, or
    chunks of them (operators.reference), each of which counts the windows that it owns.
    """
    seq = F.substring("seq", 1, CHUNK + mask.span - 1).alias("seq") if is_chunked(seqs) else F.col("seq")
    counted = spread(seqs.select(seq)).mapInArrow(_count(mask, fold_a), "key long, n long")
    freq = counted.groupBy("key").agg(F.least(F.sum("n"), F.lit(LARGEST)).alias("freq"))
    return freq.select("key", key_kmer("key", mask.weight).alias("kmer"), "freq")


def frequency_statistics(freq: DataFrame) -> DataFrame:
    """One row over keys that are met: distinct_keys, total, min, max, and whole mean and median; nulls without keys."""
    met = freq.where("freq > 0")
    return met.agg(
        F.count("*").alias("distinct_keys"),
        F.sum("freq").alias("total"),
        F.min("freq").alias("min_freq"),
        F.max("freq").alias("max_freq"),
        F.floor(F.sum("freq") / F.count("*")).alias("mean_freq"),
        F.floor(F.median("freq")).cast("long").alias("median_freq"),
    )


def ignore_keys(freq: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Keys that are met fewer than least or more than most times. Keys that are not met at all count as 0 only in rejected()."""
    if least is None and most is None:
        raise ValueError("a lower or an upper bound is needed")
    if least is not None and most is not None and least > most:
        raise ValueError("the lower bound is above the upper one")
    out = F.lit(False)
    if least is not None:
        out = out | (F.col("freq") < least)
    if most is not None:
        out = out | (F.col("freq") > most)
    return freq.where(out).select("key")


def all_keys(spark, mask: Mask, freq: DataFrame) -> DataFrame:
    """freq with a row for every key of the pattern, 0 where it is not met."""
    return spark.range(4**mask.weight).withColumnRenamed("id", "key").join(freq.select("key", "freq"), "key", "left").select("key", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"))


def rejected(freq: DataFrame, ignored: DataFrame, mask: Mask) -> DataFrame:
    """One row: rejected keys, all keys, and the share with two decimals, cut off."""
    n = 4**mask.weight
    out = ignored.agg(F.count("*").alias("rejected_keys"))
    return out.select("rejected_keys", F.lit(n).cast("long").alias("all_keys"), (F.floor(F.col("rejected_keys") * 10000 / n) / 100).alias("rejected_percent"))


def pack_bits(keys: DataFrame) -> DataFrame:
    """(byte, value): bit b of byte j is key 8 j + b; bytes of no key are left out."""
    bit = F.expr("shiftleft(1, CAST(key % 8 AS INT))")
    return keys.select("key").distinct().groupBy(F.floor(F.col("key") / 8).alias("byte")).agg(F.sum(bit).cast("int").alias("value"))


def unpack_bits(packed: DataFrame) -> DataFrame:
    """Keys of set bits."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.floor(F.col("value") / F.pow(F.lit(2.0), b)) % 2 == 1)
    return packed.select(F.explode(F.transform(bits, lambda b: F.col("byte") * 8 + b)).alias("key"))
