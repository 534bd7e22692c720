"""Bloom filters over whole columns, on tables of several sizes."""

import duckdb
import pytest

from lamella.plans import catalogue

WHOLE = ["bloom_union", "bloom_intersect", "bloom_xor", "bloom_fold", "bloom_contains", "bloom_contains_all"]


@pytest.fixture(scope="module", params=[1, 2_400])
def tables(spark, tmp_path_factory, request):
    at, n = str(tmp_path_factory.mktemp("bloom")), request.param
    spark.createDataFrame([(k, f"Customer#{k:09d}") for k in range(n)] + [(n, None)], "c_custkey long, c_name string").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(k, f"Supplier#{k:09d}") for k in range(n // 10 + 1)], "s_suppkey long, s_name string").write.parquet(f"{at}/supplier.parquet")
    return at, n


@pytest.mark.parametrize("name", WHOLE)
def test_whole_columns_against_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet/*.parquet'")
    rows = catalogue.queries()[name](spark, tables[0])
    wanted = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(wanted, key=str)


def test_every_name_enters_the_filter(spark, tables):
    at, n = tables
    found = {r.value: r.found for r in catalogue.queries()["bloom_contains"](spark, at).collect()}
    assert len(found) == n + n // 10 + 1
    assert all(found[f"Customer#{k:09d}"] for k in range(n))
    assert sum(found[f"Supplier#{k:09d}"] for k in range(n // 10 + 1)) <= 1 + n // 100
    assert catalogue.queries()["bloom_union"](spark, at).count() > 2 * n
