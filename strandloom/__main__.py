"""Command line: python -m strandloom map | key-freq | ignore-list | double-reference | split-fastq."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.masks import MAX_WEIGHT, parse_mask
from .operators import frequency, variants
from .plans.mapper import Mapping, Options
from .shipping import ship
from .sources import sequences, tables

SENSITIVITIES = ("high", "medium", "low", "fast")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom", description="Sequence mapping on Spark; paths may be of any file system that Spark reads.")
    todo = top.add_subparsers(dest="command", required=True)
    m = todo.add_parser("map", help="map reads to a reference; a folder of SAM files")
    m.add_argument("-r", "--reads", required=True, nargs="+", help="FASTQ, gzip and bzip2 by suffix")
    m.add_argument("-g", "--referenceGenome", required=True, nargs="+", help="FASTA, or .fof lists of such; with -B the plain genome, both strands of which are mapped to")
    m.add_argument("-o", "--outputFile", required=True)
    m.add_argument("-p", "--samplingPattern", default="12from18", help="a named pattern or one of 0 and 1")
    m.add_argument("-L", "--ignoreList", help="keys that are no seeds")
    m.add_argument("-N", "--maxMappings", type=int, default=1)
    m.add_argument("-P", "--topPercent", type=float, default=1.0)
    m.add_argument("-K", "--keepHashedKmersPercent", type=int, help="99 by default, 93 with -3; from 90 to 100")
    m.add_argument("-B", "--bisulfiteSeq", action="store_true")
    m.add_argument("-z", "--gzip", action="store_true", help="no effect: gzip is told by the suffix")
    m.add_argument("--oneFile", action="store_true", help="one SAM file by one task, for small results")
    for n, name in enumerate(SENSITIVITIES):
        m.add_argument(f"-{n}", f"--{name}", dest="sensitivity", action="store_const", const=name, default="medium")
    f = todo.add_parser("key-freq", help="k-mer frequencies of both strands, as a binary table")
    f.add_argument("-o", "--output", required=True)
    f.add_argument("-p", "--pattern", default="12from18")
    f.add_argument("-t", "--readable", action="store_true", help="k-mers, frequencies and keys as text, rarest first")
    f.add_argument("inputs", nargs="+")
    i = todo.add_parser("ignore-list", help="keys that are too frequent or too rare, as bits")
    i.add_argument("-i", "--input", required=True, help="a binary table of key-freq")
    i.add_argument("-o", "--output", required=True)
    i.add_argument("-c", "--most", type=int, help="larger frequencies are ignored")
    i.add_argument("-m", "--least", type=int, help="smaller frequencies are ignored")
    d = todo.add_parser("double-reference", help="each contig, then its reverse complement")
    d.add_argument("input")
    d.add_argument("output")
    s = todo.add_parser("split-fastq", help="reads by so many to a file")
    s.add_argument("input")
    s.add_argument("reads", type=int, help="reads of a file")
    s.add_argument("output")
    s.add_argument("--compat", action="store_true", help="files after the first hold one read more")
    return top


def _map(spark: SparkSession, o: argparse.Namespace) -> None:
    reads = sequences.read_fastq(spark, o.reads)
    refs = sequences.read_fasta_chunks(spark, o.referenceGenome)
    ignore = tables.read_ignore_list(spark, o.ignoreList) if o.ignoreList else None
    options = Options(o.samplingPattern, o.sensitivity, o.maxMappings, o.topPercent, o.keepHashedKmersPercent, o.bisulfiteSeq)
    mapping = Mapping(reads, refs, options, ignore)
    tables.write_sam(mapping.sam(), mapping.refs, o.outputFile, o.oneFile)


def _key_freq(spark: SparkSession, o: argparse.Namespace) -> None:
    mask = parse_mask(o.pattern)
    freq = frequency.kmer_frequencies(sequences.read_fasta_chunks(spark, o.inputs), mask)
    tables.write_readable_kmers(freq, o.output) if o.readable else tables.write_kmer_table(freq, mask, o.output)
    frequency.frequency_statistics(freq).show()


def _ignore_list(spark: SparkSession, o: argparse.Namespace) -> None:
    size = spark.read.format("binaryFile").load(o.input).agg(F.sum("length")).first()[0] or 0
    weight = next((w for w in range(1, MAX_WEIGHT + 1) if 4 * 4**w == size), None)
    if weight is None:
        raise ValueError("a table of k-mers has four bytes for each key of a pattern")
    mask = parse_mask("1" * weight)
    freq = frequency.all_keys(spark, mask, tables.read_kmer_table(spark, o.input))  # keys that are not met are rare ones
    ignored = frequency.ignore_keys(freq, o.least, o.most)
    tables.write_ignore_list(ignored, mask, o.output)
    frequency.rejected(freq, ignored, mask).show()


def _double_reference(spark: SparkSession, o: argparse.Namespace) -> None:
    sequences.write_fasta(variants.doubled(sequences.read_fasta(spark, o.input)), o.output)


def _split_fastq(spark: SparkSession, o: argparse.Namespace) -> None:
    sequences.write_split_fastq(sequences.read_fastq(spark, o.input), o.reads, o.output, o.compat)


COMMANDS = {"map": _map, "key-freq": _key_freq, "ignore-list": _ignore_list, "double-reference": _double_reference, "split-fastq": _split_fastq}


def main(argv: list[str] | None = None) -> int:
    options = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"strandloom {options.command}").getOrCreate()
    ship(spark)
    COMMANDS[options.command](spark, options)
    return 0


if __name__ == "__main__":
    sys.exit(main())
