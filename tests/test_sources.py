import bz2
import gzip
import random
import struct

import pytest

from strandloom.functions.bases import RC_PREFIX
from strandloom.functions.masks import parse_mask
from strandloom.operators import frequency
from strandloom.plans.mapper import map_reads
from strandloom.sources import sequences, tables


def test_fastq(spark, tmp_path):
    good = [(f"r{i}", "ACGTN"[i % 5] * (i % 7 + 1)) for i in range(250)]
    text = "".join(f"@{n} more\tx\n{s.lower()}\n+\n{'I' * len(s)}\n" for n, s in good[:100])
    (tmp_path / "a.fastq").write_text(text + "@long\n" + "A" * 2001 + "\n+\n" + "I" * 2001 + "\n")
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write("".join(f"@{n}\r\n{s}\r\n+\r\n{'I' * len(s)}\r\n" for n, s in good[100:200]))
    with bz2.open(tmp_path / "c.fastq.bz2", "wt") as f:
        f.write("".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in good[200:]) + "@cut\nACG\n")
    rows = sequences.read_fastq(spark, str(tmp_path)).orderBy("read_id").collect()
    assert [r["read_id"] for r in rows] == list(range(1, 251))
    assert [(r["name"], r["seq"], r["qual"]) for r in rows] == [(n, s, "I" * len(s)) for n, s in good]


def test_fastq_of_many_blocks(spark, tmp_path):
    rng = random.Random(1)
    reads = ["".join(rng.choice("ACGT") for _ in range(rng.randint(20, 90))) for _ in range(3000)]
    (tmp_path / "x.fastq").write_text("".join(f"@{i}\n{s}\n+\n{s}\n" for i, s in enumerate(reads)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = sequences.read_fastq(spark, str(tmp_path / "x.fastq")).orderBy("read_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["name"], r["seq"]) for r in rows] == [(str(i), s) for i, s in enumerate(reads)]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text("; comment\n>one first contig\nACGT\n  acgt\n;x\n\n>two\nNNNN\n")
    (tmp_path / "b.fa").write_text(">three x\r\nA\r\nC\r\n")
    (tmp_path / "all.fof").write_text(f"{tmp_path}/a.fa\n{tmp_path}/b.fa\n")
    rows = sequences.read_fasta(spark, str(tmp_path / "all.fof")).orderBy("ref_idx").collect()
    assert [(r["ref_idx"], r["name"], r["description"], r["seq"], r["len"]) for r in rows] == [(1, "one", "one first contig", "ACGTACGT", 8), (2, "two", "two", "NNNN", 4), (3, "three", "three x", "AC", 2)]
    (tmp_path / "bad.fa").write_text(">none\n>some\nA\n")
    with pytest.raises(Exception, match="without bases"):
        sequences.read_fasta(spark, str(tmp_path / "bad.fa")).collect()
    sequences.write_fasta(spark.createDataFrame([tuple(r)[:2] + (r["seq"],) for r in rows], "ref_idx long, name string, seq string"), str(tmp_path / "out"))
    again = sequences.read_fasta(spark, str(tmp_path / "out")).orderBy("ref_idx").collect()
    assert [(r["name"], r["seq"]) for r in again] == [(r["name"], r["seq"]) for r in rows]


def test_split_fastq(spark, tmp_path):
    reads = spark.createDataFrame([(i, f"r{i}", "AC", "II") for i in range(1, 21)], "read_id long, name string, seq string, qual string")
    sizes = lambda compat: [r["count"] for r in sequences.split_fastq(reads, 4, compat).groupBy("file").count().orderBy("file").collect()]
    assert sizes(False) == [4, 4, 4, 4, 4] and sizes(True) == [4, 5, 5, 5, 1]
    sequences.write_split_fastq(reads, 4, str(tmp_path / "s"))
    part = sequences.read_fastq(spark, str(tmp_path / "s" / "file=2")).orderBy("read_id").collect()
    assert [r["name"] for r in part] == ["r9", "r10", "r11", "r12"]


def test_kmer_tables_and_ignore_lists(spark, tmp_path):
    mask = parse_mask("8from14")
    rng = random.Random(2)
    seqs = spark.createDataFrame([("".join(rng.choice("ACGT") for _ in range(2000)),)], "seq string")
    freq = frequency.kmer_frequencies(seqs, mask).cache()
    tables.write_kmer_table(freq, mask, str(tmp_path / "k.bin"))
    raw = (tmp_path / "k.bin").read_bytes()
    assert len(raw) == 4 * 4**8
    known = {r["key"]: r["freq"] for r in freq.collect()}
    assert {i: x for i, (x,) in enumerate(struct.iter_unpack("<I", raw)) if x} == known
    assert {r["key"]: r["freq"] for r in tables.read_kmer_table(spark, str(tmp_path / "k.bin")).collect()} == known
    tables.write_readable_kmers(freq, str(tmp_path / "k.txt"))
    rows = spark.read.option("sep", "\t").csv(str(tmp_path / "k.txt")).collect()
    assert len(rows) == len(known) and all(known[int(r[2])] == int(r[1]) for r in rows)
    ignored = frequency.ignore_keys(freq, most=1)
    tables.write_ignore_list(ignored, mask, str(tmp_path / "i.bits"))
    bits = (tmp_path / "i.bits").read_bytes()
    want = {k for k, n in known.items() if n > 1}
    assert len(bits) == 4**8 // 8 and {8 * j + b for j, x in enumerate(bits) for b in range(8) if x >> b & 1} == want
    assert {r["key"] for r in tables.read_ignore_list(spark, str(tmp_path / "i.bits")).collect()} == want
    (tmp_path / "bad.bits").write_bytes(bytes(3))
    with pytest.raises(Exception, match="power of four"):
        tables.read_ignore_list(spark, str(tmp_path / "bad.bits")).collect()
    (tmp_path / "f.bytes").write_bytes(bytes([0, 7]) + bytes(62))
    small = parse_mask("1101")
    assert [tuple(r) for r in tables.read_score_factors(spark, str(tmp_path / "f.bytes"), small).collect()] == [(1, 7)]
    with pytest.raises(Exception, match="must be"):
        tables.read_score_factors(spark, str(tmp_path / "f.bytes"), mask).collect()


def test_sam_files(spark, tmp_path):
    rng = random.Random(3)
    contig = "".join(rng.choice("ACGT") for _ in range(1500))
    refs = spark.createDataFrame([(1, "c one", contig), (2, RC_PREFIX + "c", contig)], "ref_idx long, name string, seq string")
    reads = spark.createDataFrame([(1, "q", contig[100:180], "I" * 80), (2, "p", contig[50:120], "J" * 70)], "read_id long, name string, seq string, qual string")
    sam = map_reads(reads, refs.where("ref_idx = 1")).cache()
    tables.write_sam(sam, refs, str(tmp_path / "one"), one_file=True)
    (part,) = (tmp_path / "one").glob("part-*")
    lines = part.read_text().splitlines()
    assert lines[0] == "@HD\tVN:1.0" and lines[1].startswith("@PG") and lines[2] == "@SQ\tSN:c\tLN:1500"
    assert [x.split("\t")[0] for x in lines[3:]] == ["p", "q"] and len(lines[3].split("\t")) == 11
    tables.write_sam(sam, refs, str(tmp_path / "many"))
    back = {r["qname"]: r for r in tables.read_sam(spark, str(tmp_path / "many" / "body")).collect()}
    assert (back["q"]["pos"], back["q"]["cigar"], back["q"]["flag"]) == (101, "80M", 0)
