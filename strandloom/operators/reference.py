"""References as overlapping chunks, so that a contig of any length is read, scanned and aligned by many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bases import RC_PREFIX, reverse_complement_loose

#: Bases that a chunk owns, and those of the next chunks that it repeats: more than the longest read and its band.
CHUNK, OVERLAP = 1 << 14, 1 << 12
#: Parts that stored places are dealt to by key.
PARTS = 64
SCHEMA = "ref_idx long, name string, len long, stretch int, back boolean, seq string"
COLUMNS = ["ref_idx", "name", "len", "stretch", "back", "seq"]


def is_chunked(refs: DataFrame) -> bool:
    return "stretch" in refs.columns


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, name, seq in zip(*[batch.column(c).to_pylist() for c in ("ref_idx", "name", "seq")], strict=True):
            size = len(seq or "")
            for a in range(0, max(size, 1), CHUNK * 64):
                starts = list(range(a, min(a + CHUNK * 64, max(size, 1)), CHUNK))
                n = len(starts)
                cols = [[i] * n, [name] * n, [size] * n, [s // CHUNK for s in starts], [False] * n, [(seq or "")[s : s + CHUNK + OVERLAP] for s in starts]]
                types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=COLUMNS)


def chunked(refs: DataFrame) -> DataFrame:
    """(ref_idx, name, len, stretch, back, seq): chunks of contigs (ref_idx, name, seq), or refs if these are chunks.

    Chunk k has the bases from k * CHUNK on, CHUNK + OVERLAP at most. Each contig, an empty or null one too, has a
    chunk 0. In a chunk with back the sequence is the reverse complement of such a piece, of a contig that is read
    from its end (doubled).
    """
    if is_chunked(refs):
        return refs.select(*COLUMNS)
    return refs.select(F.col("ref_idx").cast("long").alias("ref_idx"), F.col("name").cast("string").alias("name"), "seq").mapInArrow(_cut, SCHEMA)


def contigs(refs: DataFrame) -> DataFrame:
    """(ref_idx, name, len) of contigs or chunks; names are a defline's first word."""
    name = F.element_at(F.split("name", r"\s+"), 1).alias("name")
    if is_chunked(refs):
        return refs.where("stretch = 0").select("ref_idx", name, "len")
    return refs.select(F.col("ref_idx").cast("long").alias("ref_idx"), name, F.coalesce(F.length("seq"), F.lit(0)).cast("long").alias("len"))


def doubled(chunks: DataFrame) -> DataFrame:
    """Chunks of each contig and of its reverse complement under a marked name: contigs 2 k - 1 and 2 k."""
    name = F.element_at(F.split("name", r"\s+"), 1)
    own = F.struct((2 * F.col("ref_idx") - 1).cast("long").alias("ref_idx"), name.alias("name"), "len", "stretch", F.lit(False).alias("back"), "seq")
    other = F.struct((2 * F.col("ref_idx")).cast("long").alias("ref_idx"), F.concat(F.lit(RC_PREFIX), name).alias("name"), "len", "stretch", F.lit(True).alias("back"), reverse_complement_loose("seq").alias("seq"))
    return chunks.select(F.explode(F.array(own, other)).alias("r")).select("r.*")


def begin_of(stretch, back, length, size):
    """Where in its contig a chunk of `size` bases begins; columns or numbers."""
    return F.when(back, length - stretch * CHUNK - size).otherwise(stretch * CHUNK)


def chunk_at(begin, need, length, back):
    """The number of the chunk that has `need` bases from place `begin` on."""
    place = F.when(back, F.greatest(length - begin - need, F.lit(0))).otherwise(begin)
    return F.floor(place / CHUNK).cast("int")


def write_places(places: DataFrame, path: str) -> DataFrame:
    """(ref_idx, pos, key) stored once, dealt by key and sorted, for readers that map against them many times."""
    parts = places.withColumn("part", F.pmod("key", F.lit(PARTS)).cast("int"))
    parts.repartition("part", F.pmod(F.floor(F.col("key") / PARTS), F.lit(16))).sortWithinPartitions("part", "key").write.partitionBy("part").parquet(path)
    return read_places(places.sparkSession, path)


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ref_idx long, pos long, key long, part int").parquet(path).select("ref_idx", "pos", "key")
