"""Seed matches by windows of the reference: the equi-join, band limits and group sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masks import Mask

#: Offset of words that the limit on a group's pairs is derived from.
WORD_OFFSET = 6
#: Diagonals beyond a window's own that a pair may lie on.
EXTRA_DIAGONALS = 10


def diagonals(reads: DataFrame) -> DataFrame:
    """One row d: the longest read's length, 100 at least."""
    return reads.where("length(seq) <= 2000").agg(F.greatest(F.lit(100), F.coalesce(F.max(F.length("seq")), F.lit(0))).cast("long").alias("d"))


def seed_matches(seeds: DataFrame, positions: DataFrame) -> DataFrame:
    """Seeds at the places of the reference that have their keys; AQE picks the join by the sides' real sizes."""
    return positions.join(seeds, "key")


def window_pairs(matches: DataFrame, lengths: DataFrame, d: int, mask: Mask) -> DataFrame:
    """Matches in each window they belong to: windows start at multiples of d and are 2 d long.

    A pair stays if its place is at most d + 10 beyond its offset in the read (the first seed of its key
    always does), and if its diagonal is not negative (the first pair of a read's strand in a window
    always does).
    lengths: ref_idx and len.
    """
    both = matches.join(lengths.select("ref_idx", "len"), "ref_idx")
    both = both.withColumn("window", F.explode(F.array(F.floor(F.col("pos") / d), F.floor(F.col("pos") / d) - 1)))
    stop = F.least(d * F.col("window") + 2 * d - 1, F.col("len") - 1)
    inside = both.where((F.col("window") >= 0) & (F.col("pos") + mask.span - 1 <= stop))
    near = inside.withColumn("hoff", F.col("pos") - d * F.col("window")).where(F.col("first") | ((F.col("hoff") <= F.col("voff") + d + EXTRA_DIAGONALS) & (F.col("voff") <= d + EXTRA_DIAGONALS)))
    order = Window.partitionBy("read_id", "strand", "ref_idx", "window").orderBy("voff", "hoff")
    pairs = near.withColumn("diagonal", F.col("hoff") - F.col("voff")).withColumn("_n", F.row_number().over(order))
    return pairs.where((F.col("_n") == 1) | (F.col("diagonal") >= 0)).select("read_id", "strand", "ref_idx", "window", "voff", "hoff", "diagonal")


def candidate_pairs(pairs: DataFrame, d: int) -> DataFrame:
    """Pairs of groups that are worth a chain: more than one pair, fewer than (d div 6) * 5."""
    whole = Window.partitionBy("read_id", "strand", "ref_idx", "window")
    return pairs.withColumn("n_pairs", F.count("*").over(whole)).where((F.col("n_pairs") > 1) & (F.col("n_pairs") < d // WORD_OFFSET * 5))
