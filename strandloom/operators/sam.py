"""SAM columns of mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import RC_PREFIX, plain_name, reverse_complement
from .reference import contigs

COLUMNS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def cigar(blocks: Column, size: Column, flip: Column) -> Column:
    """Clips, blocks and, between two blocks, the larger of both gaps: I if it is the read's, else D.

    flip: clips as seen from the other strand; the order of blocks stays as it was traced.
    """
    first, last = blocks[0], F.element_at(blocks, -1)
    head, tail = first["v"], size - last["v"] - last["size"]

    def clip(n: Column) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")

    def piece(b: Column, i: Column) -> Column:
        before = F.element_at(blocks, F.greatest(i, F.lit(1)))
        v, h = b["v"] - before["v"] - before["size"], b["h"] - before["h"] - before["size"]
        gap = F.when(v > h, F.concat(v.cast("string"), F.lit("I"))).otherwise(F.concat(h.cast("string"), F.lit("D")))
        return F.concat(F.when(i > 0, gap).otherwise(""), b["size"].cast("string"), F.lit("M"))

    traced = F.transform(F.when(flip, F.reverse(blocks)).otherwise(blocks), lambda b: b)
    ordered = F.transform(blocks, piece)
    flipped = F.transform(
        traced,
        lambda b, i: F.concat(
            F.when(
                i > 0,
                # gaps as they lie between a block and the one before it in traced order
                F.transform(
                    F.array(F.element_at(traced, F.greatest(i, F.lit(1)))),
                    lambda a: F.when(a["v"] - b["v"] - b["size"] > a["h"] - b["h"] - b["size"], F.concat((a["v"] - b["v"] - b["size"]).cast("string"), F.lit("I"))).otherwise(F.concat((a["h"] - b["h"] - b["size"]).cast("string"), F.lit("D"))),
                )[0],
            ).otherwise(""),
            b["size"].cast("string"),
            F.lit("M"),
        ),
    )
    body = F.array_join(F.when(flip, flipped).otherwise(ordered), "")
    return F.concat(clip(F.when(flip, tail).otherwise(head)), body, clip(F.when(flip, head).otherwise(tail)))


def indel_bases(blocks: Column) -> Column:
    """Inserted less deleted bases, as the CIGAR has them."""
    return F.aggregate(
        F.sequence(F.lit(1), F.size(blocks)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i == 1, 0).otherwise(
            F.transform(
                F.array(F.struct(F.element_at(blocks, F.greatest(i - 1, F.lit(1))).alias("a"), F.element_at(blocks, i).alias("b"))),
                lambda p: F.when(
                    p["b"]["v"] - p["a"]["v"] - p["a"]["size"] > p["b"]["h"] - p["a"]["h"] - p["a"]["size"], p["b"]["v"] - p["a"]["v"] - p["a"]["size"]
                ).otherwise(-(p["b"]["h"] - p["a"]["h"] - p["a"]["size"])),
            )[0]
        ),
    )


def to_sam(mappings: DataFrame, reads: DataFrame, refs: DataFrame, bisulfite: bool = False) -> DataFrame:
    """The eleven columns, and read_id, ref_idx and sw_score.

    FLAG is 0 or 16, MAPQ 99. Contigs that are reverse complements (bisulfite) give places on the strand
    they were made from, and the strand is theirs.
    """
    own = reads.select(F.col("read_id").cast("long").alias("read_id"), F.col("name").alias("qname"), F.upper("seq").alias("seq"), "qual")
    m = mappings.join(own, "read_id").join(contigs(refs).withColumnRenamed("name", "contig"), "ref_idx")
    flip = F.col("contig").startswith(RC_PREFIX) if bisulfite else F.lit(False)
    minus = flip if bisulfite else F.col("strand") == 1
    plain = F.col("a_start") + 1 + F.col("ah_start")
    turned = F.col("len") - F.col("a_start") - F.col("ah_start") - (F.col("av_stop") - F.col("av_start")) + indel_bases(F.col("ablocks"))
    return m.select(
        "read_id",
        "ref_idx",
        "sw_score",
        "qname",
        F.when(minus, 16).otherwise(0).alias("flag"),
        plain_name("contig").alias("rname"),
        F.when(flip, turned).otherwise(plain).cast("int").alias("pos"),
        F.lit(99).alias("mapq"),
        cigar(F.col("ablocks"), F.length("seq"), flip).alias("cigar"),
        F.lit("*").alias("rnext"),
        F.lit(0).alias("pnext"),
        F.lit(0).alias("tlen"),
        F.when(minus, reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"),
        F.when(minus, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"),
    )


def sam_lines(sam: DataFrame) -> DataFrame:
    return sam.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in COLUMNS]).alias("value"))


def sam_header(refs: DataFrame, version: str = "1.0") -> DataFrame:
    """Header lines in order (n, value): format, program, and a line for each contig that is no reverse complement."""
    spark = refs.sparkSession
    top = spark.createDataFrame([(-2, "@HD\tVN:1.0"), (-1, f"@PG\tID:strandloom\tPN:strandloom\tVN:{version}")], "n long, value string")
    own = contigs(refs).where(~F.col("name").startswith(RC_PREFIX)).select(F.col("ref_idx").alias("n"), F.concat(F.lit("@SQ\tSN:"), F.col("name"), F.lit("\tLN:"), F.col("len").cast("string")).alias("value"))
    return top.unionByName(own)
