"""Every registered query against its SQL, at the smallest size."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL and not n.startswith("op")])
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF)
    c = tables.execute(SQL[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == sorted(df.columns)
    assert _sorted([tuple(r) for r in df.collect()], df.columns) == _sorted(c.fetchall(), names)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_money_is_never_a_float(spark):
    for name in ("chain_report", "category_summary", "repair_amount", "build_rows"):
        kinds = dict(QUERIES[name](spark, SF).dtypes)
        assert all(not (k in ("float", "double") and c in ("credit", "debit", "balance", "printed_amount", "total_credit")) for c, k in kinds.items())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
