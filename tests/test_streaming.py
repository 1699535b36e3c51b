import random

from strandloom.streaming.reads import map_stream


def test_stream_of_reads(spark, tmp_path):
    rng = random.Random(1)
    contig = "".join(rng.choice("ACGT") for _ in range(2000))
    refs = spark.createDataFrame([(1, "c", contig)], "ref_idx long, name string, seq string")
    schema = "read_id long, name string, seq string, qual string"
    for n in range(2):
        rows = [(10 * n + i, f"r{n}{i}", contig[100 * i + n : 100 * i + n + 70], "I" * 70) for i in range(1, 4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {}

    def sink(df, n):
        got.setdefault(n, []).extend((r["qname"], r["pos"]) for r in df.collect())

    reads = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = map_stream(reads, refs, sink, str(tmp_path / "state"))
    assert q.awaitTermination(300) and q.exception() is None
    assert sorted(x for rows in got.values() for x in rows) == sorted((f"r{n}{i}", 100 * i + n + 1) for n in range(2) for i in range(1, 4))
