import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import perplexity
from strandloom.llm.perplexity import ORDER, UNIT, classify, discounts, held_out, key_tiles

from ..conftest import DATA
from .cases import EDGES, documents, ids, text


def naive_model(texts: list[bytes]):
    """Interpolated modified Kneser-Ney by its definition, over dictionaries."""
    top = Counter()
    for t in texts:
        p = b"\n" * (ORDER - 1) + t
        for i in range(len(t)):
            top[p[i : i + ORDER]] += 1
    counts = {ORDER: top}
    for n in range(ORDER - 1, 0, -1):
        before = defaultdict(set)
        for g in counts[n + 1]:
            before[g[1:]].add(g[0])
        counts[n] = Counter({g: len(s) for g, s in before.items()})
    off = {n: discounts(*[sum(1 for c in counts[n].values() if c == k) for k in (1, 2, 3, 4)]) for n in counts}
    followers = {n: defaultdict(list) for n in counts}
    for n in counts:
        for g, c in counts[n].items():
            followers[n][g[:-1]].append(c)

    def prob(g: bytes) -> float:
        n = len(g)
        lower = 1 / 256 if n == 1 else prob(g[1:])
        cs = followers[n].get(g[:-1])
        if not cs:
            return lower
        d = off[n]
        c = counts[n].get(g, 0)
        return (max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in cs) * lower) / sum(cs)

    return prob


def test_keys():
    data = np.frombuffer(b"abcdefgxyq", np.uint8)
    (tile,) = list(key_tiles(data, np.array([7, 0, 2, 1]), np.array([1, 1, 2, -1])))
    keys, doc = tile
    assert [hex(int(k)) for k in keys[:2]] == ["0x10a0a0a0a61", "0x10a0a0a6162"]
    assert int(keys[6]) == 1 << 40 | int.from_bytes(b"cdefg", "big") and int(keys[7]) == 2 << 40 | int.from_bytes(b"\n\n\n\nx", "big")
    assert doc.tolist() == [0] * 7 + [2] * 2


def test_keys_of_tiles(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 500).astype(np.uint8)
    lengths, lang = np.array([100, 3, 397]), np.array([0, 1, 0])
    whole = list(key_tiles(data, lengths, lang))[0]
    monkeypatch.setattr(perplexity, "TILE", 7)
    parts = list(key_tiles(data, lengths, lang))
    assert np.array_equal(np.concatenate([k for k, _ in parts]), whole[0]) and np.array_equal(np.concatenate([d for _, d in parts]), whole[1])


def test_scores_against_the_definition(spark):
    rng = random.Random(1)
    rows = [(i, text(rng.randint(5, 60), i), rng.choice(["en", "de"]), "a", 1) for i in range(400)] + [(5000, "never ### seen %%% signs", "en", "a", 1), (5001, "other", "xx", "a", 1)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 11 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in classify(documents(spark, rows).repartition(3), labels).collect()}
    for lang in ("en", "de"):
        train = [r[1].encode() for r in rows if r[2] == lang and r[0] < 400 and r[0] % 3 and r[0] % 11 and not held_out(np.array([r[0]]))[0]]
        prob = naive_model(train)
        for r in [r for r in rows if r[2] == lang][::15] + [r for r in rows if r[0] == 5000 and lang == "en"]:
            t = b"\n" * (ORDER - 1) + r[1].encode()
            nll = sum(-math.log(prob(t[i : i + ORDER])) for i in range(len(t) - ORDER + 1))
            n = len(r[1].encode())
            assert abs(got[r[0]]["nll"] - nll) <= n * 0.5 / UNIT + 1e-6
            assert abs(got[r[0]]["perplexity"] - math.exp(got[r[0]]["nll"] / n)) < 1e-9
    assert got[5001]["model"] is None and got[5001]["keep"] and got[5001]["perplexity"] is None


@pytest.mark.parametrize("n, first", [(3, 20), (30, 20), (30, 0), (19, 20)])
def test_thresholds_of_few_trusted_rows(spark, n, first):
    """Texts that the judged model was trained on set no thresholds; ids of first = 0 are held out, of 20 are not."""
    ids_ = [first + i % 20 + 100 * (i // 20) for i in range(n)]
    rows = [(i, text(40, i), "en", "a", 1) for i in ids_] + [(10_000 + i, text(40, 5000 + i), "en", "a", 1) for i in range(100)]
    labels = spark.createDataFrame([(i, 1, 0) for i in ids_], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in classify(documents(spark, rows), labels).collect()}
    assert sum(got[10_000 + i]["keep"] for i in range(100)) >= 90
    if n < perplexity.LEAST:
        assert all(r["model"] is None and r["score"] is None and r["keep"] for r in got.values())
        return
    own, fold = dict(zip(ids_, perplexity.folds(np.array(ids_)), strict=True)), {}
    for f in set(own.values()):
        fold[f] = naive_model([text(40, i).encode() for i in ids_ if own[i] != f])
    nll, size = {}, {}
    for i in ids_:
        raw = text(40, i).encode()
        t, size[i] = b"\n" * (ORDER - 1) + raw, len(raw)
        nll[i] = sum(-math.log(fold[own[i]](t[k : k + ORDER])) for k in range(len(raw)))
    mean = sum(nll.values()) / sum(size.values())
    scores = [(nll[i] + perplexity.SMOOTH * mean) / (size[i] + perplexity.SMOOTH) for i in ids_]
    assert abs(got[10_000]["low"] - min(scores) + perplexity.ROOM) < 0.02 and abs(got[10_000]["high"] - max(scores) - perplexity.ROOM) < 0.02


def test_more_languages_than_are_made_at_a_time(spark):
    """More than 64 languages all get a model, and each rejects its junk."""
    n = 70
    rows = [(1000 * g + i, text(25, 1000 * g + i), f"l{g:02d}", "a", 1) for g in range(n) for i in range(20)]
    rows += [(1000 * g + 500, "%%% ### &&& " * 30, f"l{g:02d}", "a", 1) for g in range(n)] + [(999_999, "other", None, "a", 1)]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] % 1000 < 20], "doc_id long, quality int, toxic int")
    got = classify(documents(spark, rows).repartition(3), labels).collect()
    assert ids(got) == ids(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[r[0]]["model"] == r[2] for r in rows) and by[999_999]["keep"]
    assert not any(by[1000 * g + 500]["keep"] for g in range(n))


def test_rounds_give_the_same_scores(spark, monkeypatch):
    rows = [(i, text(30, i), "abc"[i % 3], "a", 1) for i in range(120)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    once = sorted(tuple(r) for r in classify(documents(spark, rows), labels).collect())
    monkeypatch.setattr(perplexity, "MODELS", 6)
    assert sorted(tuple(r) for r in classify(documents(spark, rows), labels).collect()) == once


def test_probabilities_add_up_to_one():
    prob = naive_model([text(50, i).encode() for i in range(20)])
    for context in (b"alph", b"a be", b"zzzz", b"\n\n\n\n"):
        assert abs(sum(prob(context + bytes([c])) for c in range(256)) - 1) < 1e-9


def test_discounts():
    assert discounts(10, 5, 3, 2).tolist() == pytest.approx([0, 1 - 2 * 0.5 * 0.5, 2 - 3 * 0.5 * 0.6, 3 - 4 * 0.5 * 2 / 3])
    assert discounts(0, 1, 1, 1).tolist() == [0, 0.5, 0.75, 0.9]


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 0), (9, 1, 0), (None, 1, 0), (77, 1, 0), (10, None, None)], "doc_id long, quality int, toxic int")
    got = classify(documents(spark), labels).collect()
    assert ids(got) == ids(EDGES)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["keep"] and by[4]["keep"] and by[3]["perplexity"] is None and by[8]["model"] is None
    assert classify(documents(spark, []), labels).collect() == []
    none = classify(documents(spark), labels.where("false")).collect()
    assert len(none) == len(EDGES) and all(r["keep"] for r in none)


def test_held_out_accuracy(spark):
    """Labels that train nothing: clean documents stay, most junk goes."""
    folder = DATA.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    fold = F.pmod(F.col("doc_id"), F.lit(2)) == 1
    out = classify(docs, labels.where(fold)).join(labels.where(~fold), "doc_id")
    n = {(r["quality"], r["keep"]): r["n"] for r in out.groupBy("quality", "keep").agg(F.count("*").alias("n")).collect()}
    assert n.get((1, True), 0) >= 0.98 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.7 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_counts_and_answers_by_few_chunks_at_a_time(spark, monkeypatch):
    """However few chunks a task adds up or answers, scores are the same."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    # one language has folds, which are asked of too
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 11 == 0, "rare").otherwise(F.col("lang")))
    scores = lambda: sorted(map(tuple, classify(docs, labels).select("doc_id", "model", "nll", "low", "keep").collect()))
    monkeypatch.setattr(perplexity, "CHUNK_BYTES", 40_000)
    want = scores()
    monkeypatch.setattr(perplexity, "FAN", 2)
    monkeypatch.setattr(perplexity, "ASKING", 3)
    assert scores() == want and len(want) > 100
