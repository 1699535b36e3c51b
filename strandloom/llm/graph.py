"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, split_join


def _with_least(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (u, v), a written table, with m: the least v of u."""
    return split_join(scratch, edges, edges.groupBy("u").agg(F.min("v").alias("m")), ["u"])


def _large(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every node hands its larger neighbours to the least node that it knows (edges: u > v; some repeat)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    known = _with_least(both, scratch).withColumn("m", F.least("u", "m"))
    return known.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every node hands its smaller neighbours and itself to the least of them (edges: u > v)."""
    moved = F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u"))
    return _with_least(edges, scratch).select(moved.alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for each node of edges (u, v): component is the least node reachable.

    Least neighbours are added up before they are shuffled, and joins split the edges of a node with very many
    neighbours, so no group is held in one task. Loops and repeated edges do no harm; edges with a null end are left out.
    """
    nodes = edges.where("u is not null and v is not null")
    now = scratch.table(nodes.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if before == state:
            break
        before, last = state, now
        large = scratch.table(_large(now, scratch), "edges")
        now = scratch.table(_small(large, scratch), "edges")
        scratch.drop(last)
        scratch.drop(large)
    # at the end every edge points at its component's least node
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
