import os
import random
import re

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from strandloom.llm import registry
from strandloom.llm.decontamination import ERROR_RATE, normal
from strandloom.llm.sentencepiece import decode

from ..conftest import DATA
from .cases import EDGES, documents, text
from .test_decontamination import table
from .test_minhash import brute as components


def test_names():
    names = set(E.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_", x)[0] for x in names if x.startswith("op")} and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5 and ("pipeline" in E.oracle_sql()) == (corpus_pipeline.ORACLE_SQL is not None)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_give_what_sql_gives(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = con.execute(registry.oracle_sql()[name])
    order = [[d[0] for d in rel.description].index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in order) for r in rel.fetchall())


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables with planted cases."""
    rng = random.Random(1)
    folder = tmp_path_factory.mktemp("small")
    items = [(i, text(15, 900 + i)) for i in range(4)]
    rows = [(i, text(rng.randint(20, 60), 10_000 + i), "en", "a", 1) for i in range(100, 260)]
    rows += [(1000 + i, rows[i][1], "en", "a", 1) for i in range(5)]  # copies
    rows += [(1100 + i, " ".join([*rows[10 + i][1].split()[:-1], "changed"]), "en", "a", 1) for i in range(5)]
    rows += [(1200 + i, f"{text(8, i)} {items[i][1]} {text(8, 50 + i)}", "en", "a", 1) for i in range(4)]
    rows += [(1300, f"{text(150, 77)} write to joe@mail.example.com {text(150, 78)}", "en", "a", 1)]
    rows += [(1400 + i, "%%% ### &&& " * 30, "en", "a", 1) for i in range(3)]
    docs = documents(spark, [*rows, *[r for r in EDGES if r[0] not in (6, 7)]], clash=False)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(r[0], 1, 0) for r in rows if r[0] < 1000] + [(1400, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, items


def test_stages_one_by_one(spark, small, tmp_path):
    folder, rows, items = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept[name] = (before, docs.collect())
        if n < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)

    def ids(x):
        return {r["doc_id"] for r in x}

    before, after = kept["quality classifier"]
    assert ids(before) - ids(after) >= {1400, 1401, 1402}
    assert len({r[0] for r in rows if r[0] < 1400} - ids(after)) <= 3

    before, after = kept["MinHash near-dedup"]
    roots = components([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert ids(after) == {i for i, r in roots.items() if i == r} | {None}
    assert ids(after).isdisjoint(range(1000, 1105))

    before, after = kept["benchmark decontamination"]
    leaks = {r["doc_id"] for r in before for _, item in items if r["text"] and normal(r["text"]) and min(table(normal(item), normal(r["text"]), True)) <= int(len(normal(item)) * ERROR_RATE)}
    assert ids(before) - ids(after) == leaks >= {1200, 1201, 1202, 1203} & ids(before)

    before, after = kept["PII"]
    assert ids(before) == ids(after)
    texts = {r["doc_id"]: r for r in after}
    assert "[EMAIL]" in texts[1300]["text"] and texts[1300]["n_chars"] == len(texts[1300]["text"])
    same = {r["doc_id"]: r["text"] for r in before if r["doc_id"] != 1300}
    assert all(texts[i]["text"] == t for i, t in same.items())

    before, after = kept["SentencePiece encoding"]
    assert {(r["doc_id"], r["text"]) for r in decode(docs).collect()} == {(r["doc_id"], r["text"]) for r in before}


def test_run_is_its_stages(spark, small, tmp_path):
    folder, _, _ = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
    want = {(r["doc_id"], tuple(r["ids"] or ())) for r in docs.collect()}
    assert {(r["doc_id"], tuple(r["ids"] or ())) for r in corpus_pipeline.run(spark, folder).collect()} == want


def test_edges_and_empty_tables(spark, tmp_path):
    for name, rows in (("edges", EDGES), ("none", [])):
        documents(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/edges").collect()}
    assert got == {1, 3, 4, 5, 6, 7, 8, 10, None}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
