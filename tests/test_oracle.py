"""Every question against its SQL in another engine."""

import duckdb
import pytest

import __spark_entry__ as e

ORACLES = e.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def flat(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(str(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_same_rows(spark, sf_dir, duck, key):
    found = e.queries()[key](spark, sf_dir)
    mine = flat(found.columns, [tuple(r) for r in found.collect()])
    rel = duck.sql(ORACLES[key])
    other = flat(rel.columns, rel.fetchall())
    assert mine[0] == other[0]
    assert mine[1] == other[1]
    assert mine[1]


def test_all_questions_have_sql():
    from gondola.plans import catalogue

    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
