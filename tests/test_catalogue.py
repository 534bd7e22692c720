"""Every query with SQL against DuckDB on the smallest tables, names and types included."""

import glob
import os

import duckdb
import pytest

from lamella.plans import catalogue

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def ordered(rows):
    plain = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(plain, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, small, duck, name):
    rows = catalogue.queries()[name](spark, small)
    columns = sorted(rows.columns)
    sql = catalogue.oracle_sql()[name]
    described = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {sql}").fetchall()}
    kinds = dict(rows.dtypes)
    assert sorted(described) == columns
    assert {c: TYPES.get(described[c], described[c]) for c in columns} == kinds
    wanted = duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert ordered(rows.select(columns).collect()) == ordered(wanted)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
