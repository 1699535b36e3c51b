"""References by chunks against whole ones."""

import random

import pytest

from strandloom.functions.masks import parse_mask
from strandloom.operators import frequency, reference, seeds, variants
from strandloom.operators.sam import sam_header
from strandloom.sources.sequences import read_fasta, read_fasta_chunks

MASK = parse_mask("12from18")
C, EXTRA = reference.CHUNK, reference.OVERLAP


@pytest.fixture(scope="module")
def refs(spark):
    rng = random.Random(4)
    sizes = [1, 17, 18, C - 1, C, C + 1, C + 17, C + EXTRA, C + EXTRA + 1, 2 * C, 3 * C + 5000, 0]
    rows = [(i + 1, f"c{i} and more", "".join(rng.choice("ACGTacgtN") for _ in range(n))) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "ref_idx long, name string, seq string")


def test_chunks_cover_their_contigs(refs):
    whole = {r["ref_idx"]: r["seq"] for r in refs.collect()}
    seen = {i: 0 for i in whole}
    for r in reference.chunked(refs).orderBy("ref_idx", "stretch").collect():
        assert r["seq"] == whole[r["ref_idx"]][r["stretch"] * C : r["stretch"] * C + C + EXTRA] and r["len"] == len(whole[r["ref_idx"]]) and not r["back"]
        assert r["stretch"] == seen[r["ref_idx"]]
        seen[r["ref_idx"]] += 1
    assert {i: max(1, -(-len(s) // C)) for i, s in whole.items()} == seen
    assert {tuple(r) for r in reference.contigs(refs).collect()} == {tuple(r) for r in reference.contigs(reference.chunked(refs)).collect()}
    assert {tuple(r) for r in sam_header(refs).collect()} == {tuple(r) for r in sam_header(reference.chunked(refs)).collect()}


@pytest.mark.parametrize("step", [1, 7])
def test_places_of_chunks_are_those_of_contigs(refs, step):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    keys = lambda df: seeds.position_keys(df, MASK, step=step)
    assert rows(keys(reference.chunked(refs))) == rows(keys(refs))
    assert rows(keys(reference.doubled(reference.chunked(refs)))) == rows(keys(variants.doubled(refs)))


def test_frequencies_of_chunks_are_those_of_contigs(refs):
    rows = lambda df: sorted(tuple(r) for r in frequency.kmer_frequencies(df, MASK).collect())
    assert rows(reference.chunked(refs)) == rows(refs)


def test_fasta_by_chunks(spark, refs, tmp_path):
    rows = [r for r in refs.collect() if r["seq"]]
    with open(tmp_path / "a.fa", "w") as f:
        for r in rows:
            width = {1: 1, 5: 10**9, 11: 10**9}.get(r["ref_idx"], 61)
            f.write(f">{r['name']}\n; a remark\n")
            f.writelines(" " * (k % 3) + r["seq"][k : k + width] + "\n" for k in range(0, len(r["seq"]), width))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        own = read_fasta_chunks(spark, str(tmp_path / "a.fa"))
        order = ["ref_idx", "stretch"]
        got = [tuple(r) for r in own.select(*reference.COLUMNS).orderBy(*order).collect()]
        want = reference.chunked(read_fasta(spark, str(tmp_path / "a.fa")))
        assert got == [tuple(r) for r in want.orderBy(*order).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r["ref_idx"], r["name"], r["len"]) for r in reference.contigs(own).collect()} == {(i, r["name"].split()[0], len(r["seq"])) for i, r in enumerate(rows, 1)}
    (tmp_path / "bad.fa").write_text(">none\n>some\nA\n")
    with pytest.raises(Exception, match="without bases"):
        read_fasta_chunks(spark, str(tmp_path / "bad.fa")).collect()


def test_stored_places(spark, refs, tmp_path):
    places = seeds.position_keys(reference.chunked(refs), MASK)
    stored = reference.write_places(places, str(tmp_path / "p"))
    assert sorted(tuple(r) for r in stored.collect()) == sorted(tuple(r) for r in places.collect())
