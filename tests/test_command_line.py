import random

import pytest

from strandloom.__main__ import main, parser
from strandloom.functions.bases import RC_PREFIX
from strandloom.functions.masks import parse_mask
from strandloom.operators import frequency
from strandloom.sources import sequences, tables

MASK = parse_mask("8from14")


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng = random.Random(3)
    top = tmp_path_factory.mktemp("files")
    contigs = {f"c{i}": "".join(rng.choice("ACGT") for _ in range(2500)) for i in range(3)}
    (top / "ref.fa").write_text("".join(f">{n} text\n{s}\n" for n, s in contigs.items()))
    reads = [(f"r{i}", n, at, contigs[n][at : at + 90]) for i in range(12) for n in [rng.choice(list(contigs))] for at in [rng.randrange(2400)]]
    (top / "reads.fastq").write_text("".join(f"@{r}\n{s}\n+\n{'I' * 90}\n" for r, _, _, s in reads if len(s) == 90))
    return top, [r for r in reads if len(r[3]) == 90]


def test_map(spark, files):
    top, reads = files
    assert main(["map", "-r", f"{top}/reads.fastq", "-g", f"{top}/ref.fa", "-o", f"{top}/out", "-0", "-N", "3", "-K", "100"]) == 0
    got = {r["qname"]: (r["rname"], r["pos"]) for r in tables.read_sam(spark, f"{top}/out/body").collect()}
    assert got == {r: (n, at + 1) for r, n, at, _ in reads}
    head = [r["value"] for r in spark.read.text(f"{top}/out/header").collect()]
    assert [h for h in head if h.startswith("@SQ")] == [f"@SQ\tSN:c{i}\tLN:2500" for i in range(3)]


def test_bisulfite_map(spark, files):
    top, reads = files
    (top / "treated.fastq").write_text("".join(f"@{r}\n{s.replace('C', 'T')}\n+\n{'I' * 90}\n" for r, _, _, s in reads))
    assert main(["map", "-r", f"{top}/treated.fastq", "-g", f"{top}/ref.fa", "-o", f"{top}/treated", "-B", "--oneFile", "-3"]) == 0
    got = {r["qname"]: (r["rname"], r["pos"]) for r in tables.read_sam(spark, f"{top}/treated").collect()}
    assert got == {r: (n, at + 1) for r, n, at, _ in reads}


def test_frequencies_and_ignore_list(spark, files):
    top, _ = files
    assert main(["key-freq", "-p", "8from14", "-o", f"{top}/freq.bin", f"{top}/ref.fa"]) == 0
    want = frequency.kmer_frequencies(sequences.read_fasta(spark, f"{top}/ref.fa"), MASK).select("key", "freq")
    freq = {r["key"]: r["freq"] for r in want.collect()}
    assert {r["key"]: r["freq"] for r in tables.read_kmer_table(spark, f"{top}/freq.bin").collect()} == freq
    assert main(["key-freq", "-p", "8from14", "-t", "-o", f"{top}/freq.txt", f"{top}/ref.fa"]) == 0
    assert spark.read.csv(f"{top}/freq.txt", sep="\t").count() == len(freq)
    assert main(["ignore-list", "-i", f"{top}/freq.bin", "-o", f"{top}/ignored", "-c", "2", "-m", "1"]) == 0
    got = {r["key"] for r in tables.read_ignore_list(spark, f"{top}/ignored").collect()}
    assert got == {k for k in range(4**8) if not 1 <= freq.get(k, 0) <= 2}
    with pytest.raises(ValueError, match="bound"):
        main(["ignore-list", "-i", f"{top}/freq.bin", "-o", f"{top}/none"])


def test_doubled_reference_and_split_reads(spark, files):
    top, reads = files
    assert main(["double-reference", f"{top}/ref.fa", f"{top}/both"]) == 0
    names = [r["name"] for r in sequences.read_fasta(spark, f"{top}/both").orderBy("ref_idx").collect()]
    assert names == [x for i in range(3) for x in (f"c{i}", f"{RC_PREFIX}c{i}")]
    assert main(["split-fastq", f"{top}/reads.fastq", "4", f"{top}/parts"]) == 0
    assert [r["name"] for r in sequences.read_fastq(spark, f"{top}/parts/file=0").orderBy("read_id").collect()] == [r for r, *_ in reads[:4]]


def test_defaults():
    o = parser().parse_args(["map", "-r", "a", "-g", "b", "-o", "c"])
    assert (o.samplingPattern, o.sensitivity, o.maxMappings, o.topPercent, o.keepHashedKmersPercent, o.bisulfiteSeq) == ("12from18", "medium", 1, 1.0, None, False)
