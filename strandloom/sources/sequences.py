"""FASTA and FASTQ files as DataFrames, by Spark's text reader; gzip and bzip2 by suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.reference import CHUNK, OVERLAP

MAX_READ = 2000
#: Lines that share a window when lines of a file are numbered.
LINES_PER_GROUP = 100_000


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line, value): lines in the order of files (by path) and within them, numbered from 0 in each file.

    Blocks of a file are read by different tasks. A block's lines are consecutive in its task, so a line's
    number is its place there added to the lines of the blocks before; only block counts are shuffled.
    """
    raw = spark.read.option("lineSep", "\n").text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    raw = raw.withColumn("value", F.regexp_replace("value", "\r$", ""))
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("file").alias("_f"), F.col("block").alias("_b"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    joined = raw.join(starts, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    return joined.select("file", (F.col("start") + F.col("at") - F.col("first")).alias("line"), "value")


def expand_lists(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Paths, with each .fof file replaced by the paths that its lines name."""
    out: list[str] = []
    for p in [paths] if isinstance(paths, str) else paths:
        if p.lower().endswith(".fof"):
            out += [r["value"].strip() for r in spark.read.text(p).collect() if r["value"].strip()]  # one short line a file
        else:
            out.append(p)
    return out


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(read_id, name, seq, qual) of four-line records.

    The name is the first word of the first line without its first character; bases are upper case. Reads
    longer than 2000 are left out and take no id; a record that is cut short is left out. Ids count from
    1 in the order of files and records.
    """
    lines = _lines(spark, paths).withColumn("record", F.floor(F.col("line") / 4)).withColumn("part", F.col("line") % 4)
    pick = lambda n: F.max(F.when(F.col("part") == n, F.col("value")))
    records = lines.groupBy("file", "record").agg(pick(0).alias("head"), pick(1).alias("seq"), pick(3).alias("qual"), F.count("*").alias("n"))
    kept = records.where((F.col("n") == 4) & (F.length("seq") <= MAX_READ)).withColumn("g", F.floor(F.col("record") / LINES_PER_GROUP))
    sums = kept.groupBy("file", "g").agg(F.count("*").alias("n"))
    before = Window.orderBy("file", "g").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 100 000 records
    starts = sums.select(F.col("file").alias("_f"), F.col("g").alias("_g"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("file", "g").orderBy("record")
    placed = kept.join(starts, (F.col("file") == F.col("_f")) & (F.col("g") == F.col("_g"))).withColumn("read_id", F.col("start") + F.row_number().over(inside))
    name = F.element_at(F.split(F.substr("head", F.lit(2)), r"[ \t]"), 1)
    return placed.select(F.col("read_id").cast("long").alias("read_id"), name.alias("name"), F.upper("seq").alias("seq"), "qual")


def _records(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Of FASTA files: records (ref_idx, description, len), and lines of bases (ref_idx, offset, value).

    Blanks before a line, empty lines and lines after `;` are skipped. Indexes count from 1 over all files. Lines are
    numbered and their offsets added up by groups of LINES_PER_GROUP, so no task holds a file or a record.
    """
    lines = _lines(spark, expand_lists(spark, paths)).withColumn("value", F.regexp_replace("value", "^[ \t]+", "")).where("value <> '' and not startswith(value, ';')")
    lines = lines.withColumn("g", F.floor(F.col("line") / LINES_PER_GROUP)).withColumn("head", F.startswith(F.col("value"), F.lit(">")).cast("int"))
    lines = lines.withColumn("value", F.when(F.col("head") == 1, F.col("value")).otherwise(F.upper(F.regexp_replace("value", r"\s", ""))))
    sums = lines.groupBy("file", "g").agg(F.sum("head").alias("n"))
    before = Window.orderBy("file", "g").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 100 000 lines
    starts = sums.select(F.col("file").alias("_f"), F.col("g").alias("_g"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("file", "g").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.join(starts, (F.col("file") == F.col("_f")) & (F.col("g") == F.col("_g"))).withColumn("ref_idx", (F.col("start") + F.sum("head").over(inside)).cast("long")).where("ref_idx > 0")
    heads = placed.where("head = 1").select("ref_idx", F.substr("value", F.lit(2)).alias("description"))
    body = placed.where("head = 0").select("ref_idx", "file", "g", "line", "value", F.length("value").cast("long").alias("n"))
    parts = body.groupBy("ref_idx", "file", "g").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("ref_idx").orderBy("file", "g").rowsBetween(Window.unboundedPreceding, -1)  # as above, of one record
    parts = parts.select(F.col("ref_idx").alias("_r"), F.col("file").alias("_f"), F.col("g").alias("_g"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy("ref_idx", "file", "g").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    joined = body.join(parts, (F.col("ref_idx") == F.col("_r")) & (F.col("file") == F.col("_f")) & (F.col("g") == F.col("_g")))
    placed_lines = joined.select("ref_idx", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("offset"), "value")
    sizes = body.groupBy("ref_idx").agg(F.sum("n").alias("len"))
    return heads.join(sizes, "ref_idx", "left").select("ref_idx", "description", F.coalesce("len", F.lit(0)).alias("len")), placed_lines


def _named(records: DataFrame) -> DataFrame:
    """records with the name, a defline's first word; one without bases is an error, raised when its row is computed."""
    empty = F.raise_error(F.concat(F.lit("a record without bases: "), F.col("description")))
    name = F.when(F.col("len") == 0, empty.cast("string")).otherwise(F.element_at(F.split(F.trim("description"), r"\s+"), 1))
    return records.withColumn("name", name)


def _joined(parts: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda x: x["value"]), "")


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(ref_idx, name, description, seq, len) of records, a record as one row; .fof files name further files.

    Blanks before a line, empty lines and lines after `;` are skipped. The name is a defline's first word,
    the description all of it. Indexes count from 1 over all files. A record without bases is an error,
    raised when its row is computed. For contigs that are large for a row, see read_fasta_chunks.
    """
    records, lines = _records(spark, paths)
    bodies = lines.groupBy("ref_idx").agg(_joined(F.struct("offset", "value")).alias("seq"))
    return _named(records).join(bodies, "ref_idx", "left").select("ref_idx", "name", "description", "seq", "len")


def read_fasta_chunks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Chunks (operators.reference) of the records that read_fasta gives, put together from lines, never from a whole record."""
    records, lines = _records(spark, paths)
    # a line goes to each chunk that has some of its bases; long lines are cut as bytes, in work by their length
    stop = F.col("offset") + F.length("value") - 1
    least = F.greatest(F.floor((F.col("offset") - CHUNK - OVERLAP) / CHUNK) + 1, F.lit(0))
    pieces = lines.where("value <> ''").withColumn("raw", F.col("value").cast("binary")).withColumn("stretch", F.explode(F.sequence(least, F.floor(stop / CHUNK))))
    skip = F.greatest(F.col("stretch") * CHUNK - F.col("offset"), F.lit(0))
    upto = F.least(F.length("value").cast("long"), (F.col("stretch") + 1) * CHUNK + OVERLAP - F.col("offset"))
    piece = F.substring("raw", (skip + 1).cast("int"), (upto - skip).cast("int")).cast("string")
    ascii_line = F.octet_length("value") == F.length("value")  # others are not bases; they are cut by characters
    piece = F.when(ascii_line, piece).otherwise(F.substring("value", (skip + 1).cast("int"), (upto - skip).cast("int")))
    chunks = pieces.select("ref_idx", F.col("stretch").cast("int").alias("stretch"), "offset", piece.alias("value")).groupBy("ref_idx", "stretch").agg(_joined(F.struct("offset", "value")).alias("seq"))
    return chunks.join(_named(records).select("ref_idx", "name", "len"), "ref_idx", "right").select("ref_idx", "name", "len", F.coalesce("stretch", F.lit(0)).alias("stretch"), F.lit(False).alias("back"), F.coalesce("seq", F.lit("")).alias("seq"))


def write_fasta(refs: DataFrame, path: str) -> None:
    """Records of two lines, in the order of ref_idx within and across files."""
    rows = refs.select("ref_idx", F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq")).alias("value"))
    rows.repartitionByRange("ref_idx").sortWithinPartitions("ref_idx").select("value").write.text(path)


def split_fastq(reads: DataFrame, per_file: int, compat: bool = False) -> DataFrame:
    """reads with file: per_file reads each. compat: files after the first hold one more, as a counter from 0 gives."""
    n = F.col("read_id") - 1
    number = F.when(n < per_file, 0).otherwise(F.floor((n - per_file) / (per_file + 1)) + 1) if compat else F.floor(n / per_file)
    return reads.withColumn("file", number.cast("long"))


def write_split_fastq(reads: DataFrame, per_file: int, path: str, compat: bool = False) -> None:
    """A folder file=<k> for each split, of one text file."""
    rows = split_fastq(reads, per_file, compat)
    record = F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))
    rows.select("file", "read_id", record.alias("value")).repartition("file").sortWithinPartitions("file", "read_id").select("file", "value").write.partitionBy("file").text(path)
