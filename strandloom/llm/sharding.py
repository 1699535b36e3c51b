"""Sharding by balanced label propagation, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROWS_PER_SALT, Scratch, offsets, salted_join, salted_rank, spread

LAW = "rows"


def allowances(demand: DataFrame, room: DataFrame) -> DataFrame:
    """(s, t, allowed): how many rows may move from s to t, of demand (s, t, k, n) and room (t, free).

    k is the size class of the wishes, which larger classes come before. Swaps keep both loads, so of two opposite
    demands the smaller number is granted both ways; what is left goes into the target's free room, class by class,
    the largest demands first. At most shards squared rows for each class.
    """
    upto = Window.unboundedPreceding, -1
    pairs = demand.groupBy("s", "t").agg(F.sum("n").alias("whole"))
    back = F.broadcast(pairs.select(F.col("t").alias("s"), F.col("s").alias("t"), F.col("whole").alias("back")))
    swaps = demand.join(F.broadcast(pairs.join(back, ["s", "t"], "left").withColumn("swap", F.least("whole", F.coalesce("back", F.lit(0))))), ["s", "t"])
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("s", "t").orderBy(F.desc("k")).rowsBetween(*upto)), F.lit(0))
    swaps = swaps.withColumn("swap", F.greatest(F.lit(0), F.least("n", F.col("swap") - ahead))).withColumn("rest", F.col("n") - F.col("swap"))
    before = F.coalesce(F.sum("rest").over(Window.partitionBy("t").orderBy(F.desc("k"), F.desc("n"), "s").rowsBetween(*upto)), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("rest"), F.col("free") - before))
    granted = swaps.join(F.broadcast(room), "t").withColumn("more", more)
    return granted.groupBy("s", "t").agg(F.sum(F.col("swap") + F.col("more")).alias("allowed")).where("allowed > 0")


def propagate(cells: DataFrame, quota: list[int], scratch: Scratch, history: list[int] | None = None) -> DataFrame:
    """cells (g, s, n: rows of group g in shard s) after rounds of label propagation, until no move is granted.

    In a round each group's label, the shard where most of its rows lie (of equal ones that with the most room), is
    joined to the cells elsewhere, which ask to move there; wishes are summed by pairs of shards, granted as far as
    quotas allow, and the grants joined back. Groups of the largest sizes go first; smaller ones join in when those
    are granted nothing. Within a pair wishes of many rows come first; sums go by ranges of wishes, so no task holds
    all of a pair's. Every move takes rows to their group's largest cell, so the cut falls in each round and rounds
    end. history gets the number of rows outside of their group's largest cell, before each round and at the end.
    """
    spark = cells.sparkSession
    active = 64
    while True:
        load = {r["s"]: r["n"] for r in cells.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
        room = [F.struct(F.lit(s).alias("s"), F.lit(q - load.get(s, 0)).cast("long").alias("free")) for s, q in enumerate(quota)]
        room = spark.range(1).select(F.inline(F.array(*room)))
        best = F.max_by("s", F.struct("n", "free", F.xxhash64("g", "s"))).alias("t")
        labels = cells.join(F.broadcast(room), "s").groupBy("g").agg(best, F.floor(F.log2(F.sum("n")) / 3).alias("k"))
        wishes = scratch.table(cells.join(labels, "g").where("s <> t"), "wishes")
        classes = {r["k"]: r["n"] for r in wishes.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # 22 rows at most
        if history is not None:
            history.append(sum(classes.values()))
        for active in sorted((k for k in classes if k <= active), reverse=True):  # noqa: B020
            moved = scratch.table(_granted(wishes.where(F.col("k") >= active), room, scratch), "moved")
            if not moved.isEmpty():
                break
        else:
            return cells
        changes = moved.select("g", "s", (-F.col("moved")).alias("n")).unionByName(moved.select("g", F.col("t").alias("s"), F.col("moved").alias("n")))
        last, cells = cells, scratch.table(cells.unionByName(changes).groupBy("g", "s").agg(F.sum("n").alias("n")).where("n > 0"), "cells")
        for t in (last, wishes, moved):
            scratch.drop(t)


def _granted(wishes: DataFrame, room: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, s, t, moved) of wishes (g, s, n, t, k) that are granted, in whole or in part."""
    demand = wishes.groupBy("s", "t", "k").agg(F.sum("n").alias("n"))
    allowed = scratch.table(allowances(demand, room.withColumnRenamed("s", "t")), "allowed")  # shards squared rows at most
    # larger classes first, then larger cells: salts go down with both
    salted = wishes.join(F.broadcast(allowed), ["s", "t"])
    salted = salted.withColumn("_salt", ((31 - F.col("k")) * 64 + 63 - F.floor(F.log2("n"))) * 64 + F.pmod(F.xxhash64("g"), F.lit(64)))
    counts = salted.groupBy("s", "t", "_salt").agg(F.sum("n").alias("_n"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("s", "t", "_salt").orderBy(F.desc("n"), "g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = salted.join(offsets(counts, ["s", "t"]).drop("_n"), ["s", "t", "_salt"]).withColumn("before", F.col("_before") + inside)
    return asked.select("g", "s", "t", F.least(F.col("n"), F.col("allowed") - F.col("before")).alias("moved")).where("moved > 0")


def deal(groups: DataFrame, linked: int, shards: int) -> DataFrame:
    """cells of groups (g, n) whose rows are dealt round robin, one group after the other."""
    salted = groups.withColumn("_salt", F.pmod(F.xxhash64("g"), F.lit(linked // ROWS_PER_SALT + 1)))
    before = offsets(salted.groupBy("_salt").agg(F.sum("n").alias("_n")), []).drop("_n")
    inside = Window.partitionBy("_salt").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.join(before, "_salt").withColumn("first", F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    dealt = first.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    lag = F.pmod(F.col("s") - F.col("first"), F.lit(shards))
    return dealt.select("g", "s", F.when(lag < F.col("n"), F.floor((F.col("n") - 1 - lag) / shards) + 1).otherwise(0).cast("long").alias("n")).where("n > 0")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", history: list[int] | None = None) -> DataFrame:
    """Assigns every row to a shard; row counts of shards differ by one at most.

    Links join rows of equal text: a class link from each row to its group. A group's rows are held as cells
    (group, shard, count), at most `shards` to a group, so a group of any size stays small. Linked rows are dealt
    round robin, then move by label propagation under quotas (propagate). Rows without links fill what is left,
    exactly. At the end, ranks within groups and shards are taken by salted sub-groups.

    Returns id, size, text_crc32, shard, slot. Null text: size 16, CRC 0, no link. Empty text is a text
    as any other. Repeated rows are kept, each with its own slot. Other columns are ignored. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.col(text_col)
    slim = scratch.table(
        spread(docs.select(F.col(id_col), text)).select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("g"),
        ),
        "rows",
    )
    total = slim.count()
    groups = scratch.table(slim.where("g is not null").groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    linked = groups.agg(F.sum("n")).first()[0] or 0
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    cells = propagate(scratch.table(deal(groups, linked, shards), "cells"), quota, scratch, history)

    load = {r["s"]: r["n"] for r in cells.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    bounds, at = [], 0
    for s in range(shards):
        at += quota[s] - load.get(s, 0)
        bounds.append(at)
    ends = cells.withColumn("hi", F.sum("n").over(Window.partitionBy("g").orderBy("s")))  # a row for each shard
    ends = ends.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("s", "hi"))).alias("ends"), F.sum("n").alias("n"))
    known = salted_join(slim, ends, ["g"], ["doc_id", "size"], how="left")
    # rows without links are one group, dealt to as many sub-groups as their count asks for
    known = known.withColumn("g", F.when(F.col("ends").isNotNull(), F.col("g"))).withColumn("_k", (F.coalesce("n", F.lit(total - linked)) / ROWS_PER_SALT).cast("long"))
    known = scratch.table(known.select("doc_id", "size", "text_crc32", "g", "ends", "_k"), "linked")
    ranked = salted_rank(known, ["g"], F.col("_k") + 1, ["doc_id", "size", "text_crc32"], "rank")
    fill = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("rank")))
    own = F.element_at(F.filter("ends", lambda c: c["hi"] > F.col("rank")), 1)["s"]
    placed = ranked.select("doc_id", "size", "text_crc32", F.when(F.col("g").isNull(), fill).otherwise(own).cast("int").alias("shard"))
    placed = scratch.table(placed, "placed")
    out = salted_rank(placed, ["shard"], F.lit(total // shards // ROWS_PER_SALT + 1), ["doc_id", "size", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def cut_edges(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """Links of equal texts, counted against each group's largest cell, that cross shards: groups, linked, cut."""
    keyed = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("g")).where("g is not null")
    cells = keyed.join(placed.select("doc_id", "shard"), "doc_id").groupBy("g", "shard").agg(F.count("*").alias("n"))
    per = cells.groupBy("g").agg(F.sum("n").alias("n"), F.max("n").alias("top")).where("n > 1")
    return per.agg(F.count("*").alias("groups"), F.sum("n").alias("linked"), F.sum(F.col("n") - F.col("top")).alias("cut"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39 under the law `rows`."""
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_sharding": op1_sharding}
SQL: dict[str, str] = {}
