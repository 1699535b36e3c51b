"""How an input is dealt to tasks before work that is heavy for its size."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def plan_bytes(df: DataFrame) -> int:
    """Bytes that the plan is estimated to read: the size of its files for a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def byte_size(text: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([bkmgt]?)i?b?\s*", text.lower())
    return int(m[1]) * _UNITS[m[2]] if m else 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files would make fewer splits than there are cores, else df as it is.

    A file of one row group is one split, however many cores wait; such inputs are small, so dealing their
    rows out costs little. Inputs of more splits than cores are never shuffled here.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = byte_size(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores) if cores > 1 and plan_bytes(df) < cores * split else df
