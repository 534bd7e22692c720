"""The catalogue's page encodings go on past a run's pages, as one sequential writer's do."""

import pytest

from lamella.operators import encoding
from lamella.plans import catalogue

PAGE, ROWS = 8, 8 * (encoding.RUN_PAGES + 200)


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("runs"))
    rows = [(k, k // 64 % 500 + k % 3, float(k), f"{k % 5}-x") for k in range(ROWS)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{at}/orders.parquet")
    return at, rows


def walked(values):
    writer = encoding.Writer()
    return [writer.encode(values[k : k + PAGE]) for k in range(0, ROWS, PAGE)]


def test_pages_and_chain_of_several_runs(spark, orders, monkeypatch):
    monkeypatch.setattr(catalogue, "P", PAGE)
    at, rows = orders
    got = {(r.name, r.page): tuple(r)[2:] for r in catalogue.encoded_pages(spark, at).collect()}
    chain = {(r.epoch, r.page, r.len, r.base) for r in catalogue.encoded_chain(spark, at).collect()}
    for column, k in (("o_custkey", 1), ("o_orderpriority", 3), ("o_totalprice", 2)):
        pages = walked([str(r[k]) for r in rows])
        for page, w in enumerate(pages):
            assert got[column, page] == (w["encoding"], w["n"], w["epoch"], w["base"], w["width"], len(w["segment"]))
        if column == "o_custkey":
            assert chain == {(w["epoch"], page, len(w["segment"]), w["base"]) for page, w in enumerate(pages) if w["encoding"] != encoding.PLAIN}
    assert got["o_orderpriority", encoding.RUN_PAGES][0] == encoding.DIFFERENTIAL
