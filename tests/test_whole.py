"""Whole texts, held against plain Python."""

import re

from strandloom.plans import registry
from strandloom.plans.queries import MASK

from .conftest import DATA

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def items(spark) -> dict:
    return {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}


def dna(text: str) -> str:
    return "".join("ACGT"[(ord(c) - 65) % 4] for c in re.sub("[^A-Za-z]", "", text).upper())


def test_reverse_complements_of_whole_texts(spark):
    got = {r["item_id"]: r for r in registry.queries()["reverse_complements"](spark, DATA).collect()}
    texts = items(spark)
    assert set(got) == set(texts) and max(map(len, texts.values())) > 60
    for i, text in texts.items():
        ascii_only = re.sub("[^ -~]", "-", text)
        assert got[i]["strict"] == re.sub("[^ACGT]", "N", ascii_only.upper()).translate(COMPLEMENT)[::-1]
        assert got[i]["loose"] == ascii_only.translate(str.maketrans("AaCcGgTtn", "TTGGCCAAN"))[::-1]
        assert got[i]["complement"] == dna(text).translate(COMPLEMENT)


def test_keys_of_every_window(spark):
    rows = registry.queries()["scalar_functions"](spark, DATA).collect()
    want = {}
    for i, text in items(spark).items():
        seq = dna(text)
        for pos in range(len(seq) - MASK.span + 1):
            kmer = "".join(seq[pos + o] for o in MASK.offsets)
            want[i, pos] = kmer, sum("ATGC".index(c) * 4**k for k, c in enumerate(kmer))
    assert {(r["item_id"], r["pos"]): (r["kmer"], r["key"]) for r in rows} == want and len(rows) == len(want)
