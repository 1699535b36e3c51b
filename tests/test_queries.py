import os

import duckdb
import pytest

import __spark_entry__ as E
from strandloom.plans import registry

from .conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_what_sql_gives(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    by = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=by)
    rel = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=by)


def test_entry(spark):
    out = E.entry(spark)
    assert out.columns == ["item_id", "doc_id", "diagonal", "n_seeds"] and out.count() > 0


def test_mappings_lie_where_seeds_are(spark):
    hits = {(r["item_id"], r["doc_id"]): r["diagonal"] for r in E.entry(spark).collect()}
    rows = registry.queries()["mappings"](spark, DATA).collect()
    assert rows and {(r["read_id"], r["ref_idx"]) for r in rows} <= set(hits)
    assert all(abs(r["pos"] - 1 - hits[r["read_id"], r["ref_idx"]]) <= 10 for r in rows)
