import random
from collections import Counter

import numpy as np

from strandloom.functions.bases import RC_PREFIX
from strandloom.functions.masks import parse_mask
from strandloom.operators import alignment, frequency, seeds
from strandloom.operators.chains import Chains
from strandloom.operators.selection import final_filter, replay
from strandloom.operators.variants import call_variants, doubled
from strandloom.plans.mapper import Mapping, Options, map_reads

MASK = parse_mask("12from18")
COMPLEMENT = str.maketrans("ACGT", "TGCA")


def rc(s: str) -> str:
    return s[::-1].translate(COMPLEMENT)


def key_of(s: str, mask=MASK) -> int:
    return sum(max("ATGC".find(s[o]), 0) * 4**i for i, o in enumerate(mask.offsets))


def bases(rng, n: int) -> str:
    return "".join(rng.choice("ACGT") for _ in range(n))


def refs_df(spark, seqs: dict[str, str]):
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(seqs.items(), 1)], "ref_idx long, name string, seq string")


def reads_df(spark, seqs: list[str]):
    return spark.createDataFrame([(i, f"r{i}", s, "".join(chr(33 + j % 40) for j in range(len(s)))) for i, s in enumerate(seqs, 1)], "read_id long, name string, seq string, qual string")


def test_read_seeds(spark):
    rng = random.Random(1)
    seqs = [bases(rng, 40), bases(rng, 17), bases(rng, 120), "acgtn" * 10, bases(rng, 2001), None]
    got = {tuple(r) for r in seeds.read_seeds(spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_id long, seq string"), MASK).collect()}
    want = set()
    for i, s in enumerate(seqs):
        if s is None or not 18 <= len(s) <= 2000:
            continue
        step = {40: 3, 50: 3, 120: 12}[len(s)]
        up = s.upper()
        back = "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(c, "N") for c in reversed(up))
        for strand, own in ((0, up), (1, back)):
            want |= {(i, strand, p, key_of(own[p:])) for p in range(0, len(s) - 17, step)}
    assert got == want


def test_position_keys_skip_zero_and_tiles(spark):
    rng = random.Random(2)
    s = bases(rng, 600_000) + "A" * 40
    df = spark.createDataFrame([(7, s)], "ref_idx long, seq string")
    rows = seeds.position_keys(df, MASK).collect()
    want = [(p, k) for p in range(len(s) - 17) if (k := key_of(s[p : p + 18]))]
    assert sorted((r["pos"], r["key"]) for r in rows) == want
    few = spark.createDataFrame([(want[5][1],), (want[300_000][1],)], "key long")
    kept = seeds.position_keys(df, MASK, presence=seeds.presence_map(few, MASK)).collect()
    assert {r["key"] for r in kept} == {want[5][1], want[300_000][1]}


def test_kmer_frequencies_against_brute_force(spark):
    rng = random.Random(3)
    mask = parse_mask("8from14")
    seqs = [bases(rng, 300), "acgt" * 20, bases(rng, 50) + "N" + bases(rng, 13), "ACGT", None, ""]
    count = Counter()
    for s in seqs:
        up = (s or "").upper()
        for p in range(len(up) - mask.span + 1):
            w = up[p : p + mask.span]
            if set(w) <= set("ACGT"):
                count[key_of(w, mask)] += 1
                count[key_of(rc(w), mask)] += 1
    freq = frequency.kmer_frequencies(spark.createDataFrame([(s,) for s in seqs], "seq string"), mask)
    assert {r["key"]: r["freq"] for r in freq.collect()} == count
    stats = frequency.frequency_statistics(freq).first()
    values = sorted(count.values())
    assert (stats["total"], stats["min_freq"], stats["max_freq"], stats["distinct_keys"]) == (sum(values), values[0], values[-1], len(values))
    assert stats["total"] % 2 == 0
    empty = frequency.frequency_statistics(freq.where("false")).first()
    assert empty["distinct_keys"] == 0 and empty["mean_freq"] is None
    low = frequency.kmer_frequencies(spark.createDataFrame([("a" + "CGT" * 10,)], "seq string"), mask, fold_a=False)
    assert low.agg({"freq": "sum"}).first()[0] == 2 * (31 - 14)


def test_ignore_lists(spark):
    mask = parse_mask("1101")
    freq = spark.createDataFrame([(k, "", f) for k, f in ((0, 5), (9, 1), (10, 9), (63, 7))], "key long, kmer string, freq long")
    assert {r["key"] for r in frequency.ignore_keys(freq, least=2, most=6).collect()} == {9, 10, 63}
    packed = frequency.pack_bits(frequency.ignore_keys(freq, least=2, most=6))
    assert {(r["byte"], r["value"]) for r in packed.collect()} == {(1, 6), (7, 128)}
    assert {r["key"] for r in frequency.unpack_bits(packed).collect()} == {9, 10, 63}
    whole = frequency.all_keys(spark, mask, freq)
    share = frequency.rejected(whole, frequency.ignore_keys(whole, least=1), mask).first()
    assert (share["rejected_keys"], share["all_keys"], share["rejected_percent"]) == (60, 64, 93.75)


def test_threshold(spark):
    counts = spark.createDataFrame([(i, 1) for i in range(95)] + [(200, 5)], "key long, n long")
    assert seeds.frequency_threshold(counts, 90).first()["threshold"] == 1
    assert seeds.frequency_threshold(counts, 99).first()["threshold"] == 5


def naive_scores(read: str, ref: str, band: int, bisulfite: bool = False) -> list[list[int]]:
    h = [[0] * (band + 2)]
    for i, c in enumerate(read):
        row = [0] * (band + 2)
        for j in range(1, band + 1):
            t = ref[i + j - 1]
            same = c == t or (bisulfite and (c, t) == ("T", "C"))
            row[j] = max(0, h[-1][j] + (1 if same else -2), h[-1][j + 1] - 3, row[j - 1] - 3)
        h.append(row)
    return h


def test_banded_alignment_against_cells():
    rng = random.Random(4)
    for trial in range(60):
        band = rng.choice([3, 7, 19])
        reads = [bases(rng, rng.randint(5, 60)) for _ in range(5)]
        refs = []
        for r in reads:
            t = list(r)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(t))
                rng.choice([lambda t=t, k=k: t.__setitem__(k, "A"), lambda t=t, k=k: t.insert(k, "G"), lambda t=t, k=k: t.pop(k)])()
            refs.append((bases(rng, band // 2) + "".join(t) + bases(rng, band + 10))[: len(r) + band])
        got = alignment.aligned([r.encode() for r in reads], [t.encode() for t in refs], band, trial % 2 == 1)
        for r, t, (score, found) in zip(reads, refs, got, strict=True):
            h = naive_scores(r, t.ljust(len(r) + band, "@"), band, trial % 2 == 1)
            top = max(max(row) for row in h)
            if trial % 2 or score:
                assert score == top
            if not found:
                continue
            cost = found["n_match"] - 2 * found["n_mismatch"] - 3 * found["n_gap"]
            assert cost == top
            assert sum(n for _, _, n in found["blocks"]) == found["n_match"] + found["n_mismatch"]
            v, hh, n = found["blocks"][0]
            assert (v, hh) == (found["v_start"], found["h_start"])
            assert found["blocks"][-1][0] + found["blocks"][-1][2] - 1 == found["v_stop"]


def test_identity_rule():
    ok = {"n_match": 90, "n_mismatch": 5, "n_gap": 3}
    assert alignment.identical_enough(ok, 100)
    assert not alignment.identical_enough(ok | {"n_match": 89}, 100)
    assert not alignment.identical_enough(ok | {"n_gap": 5}, 100)


def test_chain_of_one_diagonal_and_of_a_gap():
    c = Chains(MASK)
    v = [0, 12, 24, 60]
    top, runs = c.best(v, [x + 5 for x in v])
    assert runs == [[0, 1, 2, 3]] and top == 2 * (12 + MASK.gain(12) * 2 + 12)
    top, runs = c.best([0, 20, 40], [3, 23, 45])
    assert runs == [[0, 1, 2]] and top == 24 + 24 + 24 - 2 * 3
    top, runs = c.best([0, 5], [0, 50])  # neither diagonal nor order fits
    assert top == 24 and runs == [[0], [1]]


def sample_reads(rng, contigs: dict[str, str], n: int):
    out = []
    for _ in range(n):
        name = rng.choice(list(contigs))
        size = rng.choice([50, 80, 120, 200])
        at = rng.randrange(len(contigs[name]) - size)
        s = list(contigs[name][at : at + size])
        kind = rng.choice(["exact", "substitution", "insertion", "deletion"])
        k = rng.randrange(20, size - 20)
        if kind == "substitution":
            s[k] = rng.choice([c for c in "ACGT" if c != s[k]])
        elif kind == "insertion":
            s.insert(k, rng.choice("ACGT"))
        elif kind == "deletion":
            s.pop(k)
        minus = rng.random() < 0.5
        s = "".join(s)
        out.append((rc(s) if minus else s, name, at + 1, minus))
    return out


def test_mapping_recovers_reads(spark):
    rng = random.Random(5)
    contigs = {f"c{i} some words": bases(rng, 3000) for i in range(4)}
    reads = sample_reads(rng, contigs, 80)
    # ends, a window's bound, lower case, and a duplicated locus
    first = contigs["c0 some words"]
    special = [first[:60], first[-60:], first[190:250].lower()]
    contigs["dup"] = bases(rng, 500) + first[1000:1100] + bases(rng, 500)
    reads += [(s, "c0 some words", first.upper().find(s.upper()) + 1, False) for s in special]
    df = reads_df(spark, [r[0] for r in reads] + [first[1010:1090], bases(rng, 90), "A" * 60])
    refs = refs_df(spark, contigs)
    out = {r["read_id"]: r for r in map_reads(df, refs).collect()}
    for i, (s, name, pos, minus) in enumerate(reads, 1):
        if first[1000:1100].find(s[10:40]) >= 0 or first[1000:1100].find(rc(s)[10:40]) >= 0 or (name.startswith("c0") and 1000 - len(s) < pos < 1100):
            continue
        r = out[i]
        assert r["rname"] == name.split()[0] and abs(r["pos"] - pos) <= 3 and r["flag"] == 16 * minus
        assert r["seq"] == (rc(s) if minus else s).upper() and r["mapq"] == 99
        used = sum(int(n) for n, k in __import__("re").findall(r"(\d+)([MIDS])", r["cigar"]) if k in "MIS")
        assert used == len(s)
    n = len(reads)
    assert {n + 1, n + 2, n + 3}.isdisjoint(out)
    more = map_reads(df.where(f"read_id = {n + 1}"), refs, Options(max_mappings=2)).collect()
    assert sorted(r["rname"] for r in more) == ["c0", "dup"]


def test_mapping_does_not_depend_on_partitions(spark):
    rng = random.Random(6)
    contigs = {"a": bases(rng, 2000), "b": bases(rng, 1500)}
    reads = reads_df(spark, [r[0] for r in sample_reads(rng, contigs, 25)])
    refs = refs_df(spark, contigs)
    a = {tuple(r) for r in map_reads(reads.repartition(1), refs.repartition(1)).collect()}
    b = {tuple(r) for r in map_reads(reads.repartition(7), refs.repartition(2)).collect()}
    assert a == b and len(a) >= 20


def test_bisulfite_mapping_and_methylation(spark):
    rng = random.Random(7)
    contig = bases(rng, 1500)
    refs = refs_df(spark, {"m": contig})

    def treated(s: str, keep) -> str:
        return "".join("T" if c == "C" and not keep(i) else c for i, c in enumerate(s))

    plus = contig[300:420]
    minus = rc(contig[800:920])
    reads = [treated(plus, lambda i: i % 3 == 0), treated(minus, lambda i: False)]
    m = Mapping(reads_df(spark, reads), refs, Options(bisulfite=True))
    kept = m.mappings().cache()
    sam = {r["read_id"]: r for r in m.sam(kept).collect()}
    assert (sam[1]["rname"], sam[1]["pos"], sam[1]["flag"], sam[1]["cigar"]) == ("m", 301, 0, "120M")
    assert (sam[2]["rname"], sam[2]["pos"], sam[2]["flag"], sam[2]["cigar"]) == ("m", 801, 16, "120M")
    keys = ["read_id", "strand", "ref_idx", "window", "run"]
    cut = m.with_templates(kept).select(*keys, "query", "template")
    calls = call_variants(kept.join(cut, keys), True).where("read_id = 1").collect()
    kinds = Counter(c["kind"] for c in calls)
    want = Counter()
    for i, c in enumerate(plus):
        if c == "C":
            nxt = contig[301 + i], contig[302 + i]
            want["CONV" if i % 3 else "CG" if nxt[0] == "G" else "CHG" if nxt[1] == "G" else "CHH"] += 1
    assert kinds == want


def test_variants_of_a_regular_read(spark):
    rng = random.Random(8)
    contig = bases(rng, 1000)
    s = list(contig[400:500])
    s[50] = next(c for c in "ACGT" if c != s[50])
    m = Mapping(reads_df(spark, ["".join(s)]), refs_df(spark, {"v": contig}))
    kept = m.mappings()
    keys = ["read_id", "strand", "ref_idx", "window", "run"]
    calls = call_variants(kept.join(m.with_templates(kept).select(*keys, "query", "template"), keys)).collect()
    assert [(c["pos"], c["read_pos"], c["kind"], c["allele"]) for c in calls] == [(450, 50, "SNP", s[50])]


def test_doubled_reference(spark):
    out = doubled(refs_df(spark, {"x y": "AACGn-", "z": "T"})).orderBy("ref_idx").collect()
    assert [(r["name"], r["seq"]) for r in out] == [("x", "AACGn-"), (RC_PREFIX + "x", "-NCGTT"), ("z", "T"), (RC_PREFIX + "z", "A")]


def test_replay_and_final_filter(spark):
    row = {"strand": 0, "run": 0, "anchor_match": 50, "anchor_mismatch": 0, "h_start": 0, "h_stop": 30, "chain_score": 100, "sw_score": 50, "ref_idx": 1, "window": 0}
    rows = [row, row | {"window": 1}, row | {"ref_idx": 2}, row | {"ref_idx": 3, "chain_score": 74}, row | {"ref_idx": 4, "sw_score": 10}, row | {"ref_idx": 5, "anchor_mismatch": 20}]
    assert replay(rows, 60, 18, 40, 5, 0.99) == [True, False, True, False, False, False]
    # a perfect score with more places than are asked for: no more is looked at
    far = [row | {"ref_idx": i, "sw_score": 60} for i in range(5)]
    assert replay(far, 60, 18, 40, 1, 0.99) == [True, True, False, False, False]
    df = spark.createDataFrame([(1, 100, "a"), (1, 99, "b"), (1, 98, "c"), (2, 50, "d")], "read_id long, sw_score int, x string")
    assert {r["x"] for r in final_filter(df, 2).collect()} == {"a", "b", "d"}
    assert {r["x"] for r in final_filter(df, 1).collect()} == {"d"}


def test_score_matrix_rows_beyond_a_read_are_zero():
    q = np.frombuffer(b"ACGT\0\0", np.uint8).reshape(1, 6)
    t = np.frombuffer(b"AACGTAAA@", np.uint8)[:8].reshape(1, 8)
    scores, _ = alignment.score_matrices(q, np.array([4]), t, 3, False)
    assert scores[0, 5:].max() == 0 and scores[0, 4].max() == 4
