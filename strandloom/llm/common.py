"""What the operators of this subpackage share: shared scratch tables, sizes, salted ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.layout import plan_bytes, spread
from ..operators.scratch import CLEANUP, Scratch, shared_dir

__all__ = ["CLEANUP", "ROWS_PER_SALT", "Scratch", "let", "offsets", "plan_bytes", "prefix_sums", "running", "salted_join", "salted_rank", "shared_dir", "split_join", "spread"]

#: Rows that one sub-group of a salted rank holds on average.
ROWS_PER_SALT = 64
#: Salts that a window over sub-groups' counts holds at most.
FAN = 4096


def let(value: Column, then) -> Column:
    """then(value), with value computed once however often then names it."""
    return F.transform(F.array(value), then)[0]


def running(values: Column, join, block: int = 256) -> Column:
    """join of all values before each of an array of long, from 0, in work near the array's length.

    join: an associative function of two columns with zero 0, such as a sum or (of values from 0 on) a maximum.
    """
    zero = F.array(F.lit(0).cast("long"))
    step = lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x)))

    def joined(parts: Column) -> Column:
        offsets = F.aggregate(F.transform(parts, lambda p: F.element_at(p, -1)), zero, step)
        pairs = F.arrays_zip(parts.alias("p"), F.slice(offsets, F.lit(1), F.size(parts)).alias("o"))
        return F.flatten(F.transform(pairs, lambda z: F.transform(F.slice(z["p"], F.lit(1), F.size(z["p"]) - 1), lambda v: join(z["o"], v))))

    def scan(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
        parts = F.transform(starts, lambda b: F.aggregate(F.slice(v, b * block + 1, F.lit(block)), zero, step))
        return F.when(F.size(v) > 0, let(parts, joined)).otherwise(F.array().cast("array<bigint>"))

    return let(values, scan)


def prefix_sums(values: Column) -> Column:
    """Exclusive prefix sums of an array of long."""
    return running(values, lambda a, b: a + b)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left joined with right on keys of which nulls are equal; right's keys are dropped."""
    other = right.withColumnsRenamed({c: f"_of_{c}" for c in keys})
    return left.join(other, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])).drop(*[f"_of_{c}" for c in keys])


def offsets(counts: DataFrame, group: list[str]) -> DataFrame:
    """counts (group, _salt, _n) with _before: the sum of _n over the group's smaller salts.

    Sums go by ranges of FAN salts, so that a window holds FAN rows, or a row for each range.
    """
    wide = counts.withColumn("_range", F.floor(F.col("_salt") / FAN))
    sums = wide.groupBy(*group, "_range").agg(F.sum("_n").alias("_s"))
    to_here = Window.unboundedPreceding, -1
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(*to_here)), F.lit(0))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy(*group, "_range").orderBy("_salt").rowsBetween(*to_here)), F.lit(0))
    joined = _null_safe(wide, sums.withColumn("_base", before).drop("_s"), [*group, "_range"])
    return joined.withColumn("_before", F.col("_base") + inside).drop("_base", "_range")


def salted_rank(df: DataFrame, group: list[str], salts: Column, key: list[str], out: str) -> DataFrame:
    """Adds out: a gapless rank from 0 within group, by sub-groups so that no task holds a whole group.

    salts says into how many sub-groups a row's group is dealt (the same for all its rows). df must be
    stable (a written table): it is read twice. Rows that agree in all of key take ranks in any order.
    """
    salted = df.withColumn("_salt", F.expr(f"pmod(xxhash64({', '.join(key)}), 1000000007)") % salts)
    whole = [*group, "_salt"]
    counts = salted.groupBy(*whole).agg(F.count("*").alias("_n"))
    joined = _null_safe(salted, offsets(counts, group).drop("_n"), whole)
    place = Window.partitionBy(F.hash(*whole), *whole).orderBy(*key)
    return joined.withColumn(out, F.col("_before") + F.row_number().over(place) - 1).drop("_salt", "_before")


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], by: list[str], salts: int = 64, how: str = "inner") -> DataFrame:
    """rows joined with table, which has few rows for a key, so that a key's rows are dealt to `salts` tasks.

    by: columns of rows that tell a key's rows apart. table's rows of a key go to the sub-groups that exist,
    `salts` at most, and each of these is joined by itself. how: inner or left. Null keys match nothing.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)))
    told = dealt.select(*keys, "_salt").distinct().join(table, keys)
    return dealt.join(told, [*keys, "_salt"], how).drop("_salt")


def split_join(scratch: Scratch, rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with table, which has one row for a key and is written first.

    Both sides are then shuffled as they stand, so that Spark's own skew join (on by default) splits the rows of a
    frequent key among tasks: fewer exchanges than salted_join takes, for joins that are made many times.
    """
    return rows.join(scratch.table(table, "joined", "lz4"), keys, how)
