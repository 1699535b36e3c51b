import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.functions import bases as B
from strandloom.functions.masks import PRESETS, Mask, parse_mask, random_mask, stride


def key_of(kmer: str) -> int:
    return sum(max("ATGC".find(c), 0) * 4**i for i, c in enumerate(kmer))


def test_golden_keys(spark):
    kmers = {"AGTC": 216, "CGTA": 27, "NCNN": 12, "GGCTCTCTATTTCCAA": 257193850, "TAATCGGCCCATG": 38792001, "": 0}
    rows = spark.createDataFrame([(k,) for k in kmers], "k string").select("k", B.kmer_key("k").alias("key")).collect()
    assert {r["k"]: r["key"] for r in rows} == kmers


def test_key_round_trip_and_bits(spark):
    df = spark.createDataFrame([(27,), (216,)], "key long")
    r = df.select(B.key_kmer("key", 4).alias("k"), B.base_at("key", 0).alias("b"), B.base_at("key", 16).alias("none"), B.with_base_at("key", 1, "A").alias("w"), B.binary("key", 8).alias("bits"), B.key_kmer("key", 17).alias("long")).collect()
    assert [x["k"] for x in r] == ["CGTA", "AGTC"]
    assert (r[0]["b"], r[0]["none"], r[0]["w"], r[0]["bits"], r[0]["long"]) == ("C", None, key_of("CATA"), "00011011", None)


def test_overlap_gains():
    want = {
        "12from18": "6 6 6 7 7 7 8 8 8 9 8 9 9 10 9 10 11",
        "11from18": "6 6 6 7 7 8 8 7 8 9 8 8 8 9 8 9 10",
        "8from14": "5 5 5 5 6 6 6 6 6 7 6 6 7",
        "9from15": "5 5 6 6 6 6 7 6 7 7 7 7 7 8",
        "10from16": "5 6 6 6 6 7 7 7 8 7 7 8 8 8 9",
        "13from21": "7 7 7 7 7 9 7 8 11 10 9 8 9 11 9 11 11 11 11 12",
        "14from21": "6 7 7 8 8 8 9 9 9 10 9 11 10 10 10 11 11 11 12 13",
    }
    for name, gains in want.items():
        m = parse_mask(name)
        assert list(m.gains[1 : m.span]) == [int(x) for x in gains.split()]
        assert m.gains[0] == m.gains[m.span] == m.gain(10**6) == m.weight == int(name.split("from")[0])
        assert len(PRESETS[name]) == m.span == int(name.split("from")[1])


def test_masks_reject():
    for bad in ("", "000", "12from19", "1" * 16, "10" * 26, "1x1"):
        with pytest.raises(ValueError):
            parse_mask(bad)
    assert Mask("1101").covered([0, 1]) == 5
    assert random_mask(18, 12, 5).weight == 12
    with pytest.raises(ValueError):
        random_mask(3, 4)


def test_strides(spark):
    assert [stride("medium", n) for n in (36, 37, 50, 75, 99, 100)] == [2, 3, 3, 4, 8, 12]
    assert stride("high", 100) == stride("high", 1000) == 6
    lengths = [0, 36, 37, 50, 75, 76, 99, 100, 149, 150, 200, 201, 2000]
    df = spark.createDataFrame([(n,) for n in lengths], "n int").select("n", *[B.stride_of(s, "n").alias(s) for s in ("high", "medium", "low", "fast")])
    for r in df.collect():
        assert all(r[s] == stride(s, r["n"]) for s in ("high", "medium", "low", "fast"))


def test_complements(spark):
    df = spark.createDataFrame([("AcgTNnx-",), ("",)], "s string")
    r = df.select(B.reverse_complement("s").alias("a"), B.reverse_complement_loose("s").alias("b")).collect()
    assert [tuple(x) for x in r] == [("NNNNACGT", "-xNNACGT"), ("", "")]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ACGT", max_size=30), min_size=1, max_size=20))
def test_reverse_complement_is_its_own_inverse(spark, seqs):
    df = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", B.reverse_complement(B.reverse_complement("s")).alias("t"))
    assert all(r["s"] == r["t"] for r in df.collect())


def test_bisulfite_expansion(spark):
    def brute(kmer: str) -> list[int]:
        ts = [i for i, c in enumerate(kmer) if c == "T"]
        n = 2 ** len(ts)
        picks = list(range(min(n, 512))) + ([n - 1] if n > 512 else [])
        return [key_of("".join("C" if i in ts and not p >> (len(ts) - 1 - ts.index(i)) & 1 else c for i, c in enumerate(kmer))) for p in picks]

    kmers = ["ACTGTTTA", "AAAACGCG", "TTTTTTTT", "T" * 12]
    for k in kmers:
        (r,) = spark.createDataFrame([(key_of(k),)], "key long").select(B.bisulfite_keys("key", len(k)).alias("x")).collect()
        assert r["x"] == brute(k), k
    assert len(brute("T" * 12)) == 513


def test_projection_and_names(spark):
    df = spark.createDataFrame([("Aé bE ß?", B.RC_PREFIX + "chr1")], "t string, n string")
    r = df.select(B.dna("t").alias("d"), B.plain_name("n").alias("n"), B.base_number(F.lit("N")).alias("a"), B.base_number(F.lit("x")).alias("b"), B.is_base(F.lit("G")).alias("g")).first()
    assert (r["d"], r["n"], r["a"], r["b"], r["g"]) == ("ACA", "chr1", 4, 5, True)
