"""Mapping queries against their SQL on reads with substitutions, insertions, deletions, both strands and treated bases."""

import random

import duckdb
import pytest

from strandloom.operators.reference import CHUNK, OVERLAP
from strandloom.plans import registry

NAMES = ["window_pairs", "candidate_groups", "chains", "alignments", "mappings", "bisulfite_mappings", "variant_calls", "methylation_calls", "contig_coverage", "run_counters", "seeds_per_read"]
#: Letters whose projection is the base.
AS_TEXT = str.maketrans("ACGT", "ABCD")


def bases(rng, n: int) -> str:
    return "".join(rng.choice("ACGT") for _ in range(n))


def spoiled(rng, s: str, edits: int) -> str:
    out = list(s)
    for _ in range(edits):
        k = rng.randrange(len(out))
        what = rng.random()
        if what < 0.5:
            out[k] = rng.choice("ACGT")
        elif what < 0.75:
            out[k:k] = bases(rng, rng.choice([1, 1, 2, 5]))
        else:
            del out[k : k + rng.choice([1, 1, 2, 6])]
    return "".join(out)


@pytest.fixture(scope="module", params=range(3))
def folder(spark, tmp_path_factory, request):
    rng = random.Random(request.param)
    top = str(tmp_path_factory.mktemp("engine"))
    unit = bases(rng, 90)
    contigs = [bases(rng, rng.choice([300, 1500, 4000])) for _ in range(8)]
    contigs += [bases(rng, 200) + unit * 3 + bases(rng, 150) + unit, unit, bases(rng, 17), "A" * 400, bases(rng, 700) + contigs[0][100:300] + bases(rng, 60)]
    reads = []
    for _ in range(70):
        c = rng.choice([c for c in contigs if len(c) > 60])
        size = min(len(c), rng.choice([40, 80, 120, 200, 300]))
        at = rng.choice([0, len(c) - size, rng.randrange(len(c) - size + 1)])
        s = spoiled(rng, c[at : at + size], rng.choice([0, 0, 1, 2, 4, 9]))
        if rng.random() < 0.3:
            s = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        if rng.random() < 0.3:
            s = "".join("T" if b == "C" and rng.random() < 0.7 else b for b in s)
        reads.append(s)
    reads += ["", "ACGT", "A" * 80, bases(rng, 60), unit + unit]
    long = bases(rng, 2 * CHUNK + 900)  # of three chunks; reads lie where these meet, and at its ends
    contigs.append(long)
    for at in (0, CHUNK - 300, CHUNK - 90, CHUNK - 1, CHUNK, 2 * CHUNK - 60, CHUNK + OVERLAP - 50, len(long) - 130, 900 - 60, 900):
        s = spoiled(rng, long[at : at + rng.choice([60, 130])], rng.choice([0, 1, 3]))
        reads += [s, s[::-1].translate(str.maketrans("ACGT", "TGCA")), s.replace("C", "T")]
    docs = [(i + 1, c.translate(AS_TEXT)) for i, c in enumerate(contigs)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, r.translate(AS_TEXT)) for i, r in enumerate(reads)], "item_id long, text string").coalesce(1).write.parquet(f"{top}/benchmark.parquet")
    return top


@pytest.mark.parametrize("name", NAMES)
def test_spoiled_reads(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = registry.queries()[name](spark, folder)
    cols = sorted(df.columns)
    order = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=order)
    rel = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=order)
    assert got
