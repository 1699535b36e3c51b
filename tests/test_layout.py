from strandloom.operators.layout import byte_size, plan_bytes, spread

from .conftest import DATA


def test_sizes():
    assert [byte_size(x) for x in ("1024", "16m", "128MB", "1 g", "64k", "134217728b", "x")] == [1024, 16 << 20, 128 << 20, 1 << 30, 64 << 10, 128 << 20, 128 << 20]


def test_small_inputs_are_spread_and_large_ones_are_not(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    assert plan_bytes(df) > 0 and "Exchange" in spread(df)._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert "Exchange" not in spread(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
