"""The driver's contract, and the queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from vellumspark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return repr(v + 0.0)
        return repr(v)

    return sorted(tuple(map(one, r)) for r in rows)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "rank", "bm25_score"] and df.count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(found.fetchall())
