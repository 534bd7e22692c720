"""The operators that SQL can express, against DuckDB."""

import glob
import os

import duckdb
import pytest

from lamella.llm import registry

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    rows, sql = registry.queries()[name](spark, small), registry.oracle_sql()[name]
    columns = sorted(rows.columns)
    described = {r[0]: TYPES.get(r[1], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    assert described == dict(rows.dtypes)
    wanted = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert sorted(map(str, (tuple(r) for r in rows.select(columns).collect()))) == sorted(map(str, wanted))
