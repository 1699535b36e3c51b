"""Variants and methylation states of aligned bases, and the strand-doubled reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import RC_PREFIX, reverse_complement_loose


def doubled(refs: DataFrame) -> DataFrame:
    """Each contig followed by its reverse complement under a marked name; names are a defline's first word."""
    name = F.element_at(F.split("name", r"\s+"), 1)
    both = F.array(
        F.struct((2 * F.col("ref_idx") - 1).cast("long").alias("ref_idx"), name.alias("name"), F.col("seq").alias("seq")),
        F.struct((2 * F.col("ref_idx")).cast("long").alias("ref_idx"), F.concat(F.lit(RC_PREFIX), name).alias("name"), reverse_complement_loose("seq").alias("seq")),
    )
    return refs.select(F.explode(both).alias("r")).select("r.*")


def aligned_bases(mappings: DataFrame) -> DataFrame:
    """A row for each aligned base: read place, reference place, both letters, and the two reference letters that follow.

    mappings: with query, template, a_start and ablocks.
    """
    at = lambda c, p, n=1: F.substr(F.col(c), p + n, F.lit(1))

    def base(v, h):
        letters = {"base": at("query", v), "ref_base": at("template", h), "next1": at("template", h, 2), "next2": at("template", h, 3)}
        return F.struct(v.alias("read_pos"), (F.col("a_start") + h).alias("pos"), *[c.alias(n) for n, c in letters.items()])

    # letters are taken before rows are made, so that no row carries sequences
    letters = F.transform("ablocks", lambda b: F.transform(F.sequence(F.lit(0), b["size"] - 1), lambda i: base(b["v"] + i, b["h"] + i)))
    rows = mappings.select("read_id", "ref_idx", F.explode(F.flatten(letters)).alias("p"))
    return rows.select("read_id", "ref_idx", "p.*")


def call_variants(mappings: DataFrame, bisulfite: bool = False) -> DataFrame:
    """(read_id, ref_idx, pos, read_pos, kind, allele), places from 0.

    bisulfite: C over C is methylated, in context CG, CHG or CHH; T over C is CONV; any other difference
    is a SNP. Else every difference is a SNP.
    """
    b = aligned_bases(mappings)
    differs = F.col("base") != F.col("ref_base")
    if bisulfite:
        over_c = F.col("ref_base") == "C"
        kind = (
            F.when(over_c & (F.col("base") == "C"), F.when(F.col("next1") == "G", "CG").when(F.col("next2") == "G", "CHG").otherwise("CHH"))
            .when(over_c & (F.col("base") == "T"), "CONV")
            .when(differs, "SNP")
        )
    else:
        kind = F.when(differs, "SNP")
    return b.withColumn("kind", kind).where("kind is not null").select("read_id", "ref_idx", "pos", "read_pos", "kind", F.col("base").alias("allele"))


def coverage(mappings: DataFrame) -> DataFrame:
    """(ref_idx, mappings, bases): mappings of each contig and the bases of their blocks."""
    size = F.aggregate("ablocks", F.lit(0), lambda acc, b: acc + b["size"])
    return mappings.groupBy("ref_idx").agg(F.count("*").alias("mappings"), F.sum(size).alias("bases"))
