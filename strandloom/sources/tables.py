"""K-mer tables, ignore lists and score factors in their binary and readable forms, and SAM files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masks import Mask
from ..operators.frequency import pack_bits
from ..operators.sam import sam_header, sam_lines

#: Bytes of a binary file that are one row on the way out.
SEGMENT = 1 << 16


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")


def _write_segments(cells: DataFrame, dtype: str, size: int, path: str) -> None:
    """cells (at, value) as one file of `size` numbers; the driver holds one segment at a time."""
    per = SEGMENT // np.dtype(dtype).itemsize

    def fill(key, table):
        out = np.zeros(per, dtype)
        at = table.column("at").to_numpy()
        out[at % per] = table.column("value").to_numpy().astype(dtype)
        return pa.table({"s": pa.array([int(at[0] // per)]), "bytes": pa.array([out.tobytes()], pa.binary())})

    parts = cells.withColumn("s", F.floor(F.col("at") / per)).groupBy("s").applyInArrow(fill, "s long, bytes binary").orderBy("s")
    place, name = _open(path)
    total, done = size * np.dtype(dtype).itemsize, 0
    with place.open_output_stream(name) as sink:
        for r in parts.toLocalIterator():
            while done < r["s"] * SEGMENT:
                sink.write(bytes(min(SEGMENT, total - done)))
                done += SEGMENT
            sink.write(r["bytes"][: total - done])
            done += len(r["bytes"])
        while done < total:
            sink.write(bytes(min(SEGMENT, total - done)))
            done += SEGMENT


def write_kmer_table(freq: DataFrame, mask: Mask, path: str) -> None:
    """A 32-bit little-endian count for each key of the pattern."""
    _write_segments(freq.select(F.col("key").alias("at"), F.col("freq").alias("value")), "<u4", 4**mask.weight, path)


def write_readable_kmers(freq: DataFrame, path: str) -> None:
    """kmer, freq and key by tabs, keys that are met, rarest first."""
    freq.where("freq > 0").orderBy("freq", "key").select("kmer", "freq", "key").write.option("sep", "\t").csv(path)


def _numbers(dtype: str, name: str):
    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                values = np.frombuffer(content, dtype)
                for a in range(0, len(values), 1 << 20):
                    met = np.flatnonzero(values[a : a + (1 << 20)]) + a
                    yield pa.record_batch([pa.array(met), pa.array(values[met].astype(np.int64))], names=["key", name])

    return run


def read_kmer_table(spark: SparkSession, path: str) -> DataFrame:
    """(key, freq) of keys that are met."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_numbers("<u4", "freq"), "key long, freq long")


def read_score_factors(spark: SparkSession, path: str, mask: Mask) -> DataFrame:
    """(key, factor) of a byte for each key; the file must have exactly one for each. Factors of 0 are left out."""
    size = 4**mask.weight
    files = spark.read.format("binaryFile").load(path)
    checked = files.select(F.when(F.col("length") == size, F.col("content")).otherwise(F.raise_error(F.lit(f"score factors must be {size} bytes")).cast("binary")).alias("content"))
    return checked.mapInArrow(_numbers("u1", "factor"), "key long, factor long")


def write_ignore_list(ignored: DataFrame, mask: Mask, path: str) -> None:
    """A bit for each key: bit b of byte j is key 8 j + b."""
    bits = pack_bits(ignored).select(F.col("byte").alias("at"), "value")
    _write_segments(bits, "u1", max(1, 4**mask.weight // 8), path)


def read_ignore_list(spark: SparkSession, path: str) -> DataFrame:
    """Keys of set bits; the number of bits must be a power of four."""
    bits = F.col("length") * 8
    weight = F.round(F.log(4.0, bits))
    fits = F.pow(F.lit(4.0), weight) == bits
    files = spark.read.format("binaryFile").load(path)
    checked = files.select(F.when(fits, F.col("content")).otherwise(F.raise_error(F.lit("an ignore list must have a power of four of bits")).cast("binary")).alias("content"))

    def run(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                for a in range(0, len(content), 1 << 17):
                    keys = np.flatnonzero(np.unpackbits(np.frombuffer(content[a : a + (1 << 17)], np.uint8), bitorder="little"))
                    yield pa.record_batch([pa.array(keys + 8 * a)], names=["key"])

    return checked.mapInArrow(run, "key long")


def write_sam(sam: DataFrame, refs: DataFrame, path: str, one_file: bool = False) -> None:
    """A folder header of the header's lines and one body of records in the order of contigs and places.

    Readers take them in that order; one_file puts all lines into one file by one task, for small results.
    """
    if one_file:
        head = sam_header(refs).select(F.lit(0).alias("k"), F.col("n").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "value")
        body = sam.withColumn("value", sam_lines_column()).select(F.lit(1).alias("k"), F.col("ref_idx").cast("long").alias("a"), F.col("pos").cast("long").alias("b"), "value")
        head.unionByName(body).repartition(1).sortWithinPartitions("k", "a", "b", "value").select("value").write.text(path)
        return
    sam_header(refs).repartition(1).sortWithinPartitions("n").select("value").write.text(f"{path}/header")
    sam_lines(sam.repartitionByRange("ref_idx", "pos").sortWithinPartitions("ref_idx", "pos", "qname")).write.text(f"{path}/body")


def sam_lines_column():
    from ..operators.sam import COLUMNS

    return F.concat_ws("\t", *[F.col(c).cast("string") for c in COLUMNS])


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven columns of SAM records; header lines are skipped."""
    f = F.split("value", "\t", -1)
    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    whole = {"flag", "pos", "mapq", "pnext", "tlen"}
    return spark.read.text(path).where("not value rlike '^@[A-Z]{2}\\t'").select(*[(f[i].cast("int") if n in whole else f[i]).alias(n) for i, n in enumerate(names)])
