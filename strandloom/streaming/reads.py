"""Reads that arrive as a stream, mapped batch by batch against a fixed reference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import reference, seeds
from ..plans.mapper import Mapping, Options
from ..shipping import ship


def stored_reference(refs: DataFrame, options: Options, path: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of the reference, and the places of all its keys, as tables below path; written unless they are there whole."""
    spark = refs.sparkSession

    def stored(name: str, write) -> None:
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            folder = done.getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)  # of a writer that was cut off
            write(f"{path}/{name}")

    stored("chunks", lambda p: reference.chunked(refs).write.parquet(p))
    chunks = spark.read.schema(reference.SCHEMA).parquet(f"{path}/chunks")
    scanned = reference.doubled(chunks) if options.bisulfite else chunks
    stored("places", lambda p: reference.write_places(seeds.position_keys(scanned, options.mask), p))
    return chunks, reference.read_places(spark, f"{path}/places")


def map_stream(reads: DataFrame, refs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, options: Options = Options(), trigger: dict | None = None) -> StreamingQuery:  # noqa: B008
    """Starts a query that maps each micro-batch of reads (read_id, name, seq, qual) and hands SAM columns to sink.

    The reference's chunks and its places by key are stored below the checkpoint once, and read by each batch; a stream
    that goes on from its checkpoint reads those that are there. Reads are independent but for two values, which here hold for each batch: the longest read and the
    threshold of seed frequency. sink gets the batch's number with its rows, so that it can write each
    batch once when a batch is run again.
    """

    spark = refs.sparkSession
    ship(spark)
    chunks, places = stored_reference(refs, options, f"{checkpoint}/reference")

    def batch(df: DataFrame, n: int) -> None:
        held = df.persist()
        try:
            if not held.isEmpty():
                sink(Mapping(held, chunks, options, places=places).sam(), n)
        finally:
            held.unpersist()

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
