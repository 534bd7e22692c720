import io

import pytest

from lamella import cli
from lamella.operators.table import Table, batches, equi_filter, equi_page_counts, formatted, lookup, scan


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, f"v{k % 5}", "" if k % 4 == 0 else f"{k}") for k in range(25)]
    return Table(spark.createDataFrame(rows, "rid long, c0 string, c1 string"), page_size=10)


def test_scan_by_position_and_repeat(table):
    rows = scan(table, [1, "c0", 1], ordered=True)
    assert rows.columns == ["c1", "c0", "c1_1"]
    assert [tuple(r) for r in rows.take(2)] == [("", "v0", ""), ("1", "v1", "1")]


def test_unknown_column(table):
    with pytest.raises(ValueError):
        scan(table, ["nope"])


def test_filter_is_scan_and_where(table):
    got = equi_filter(table, "c0", "v3", ["c1"], ordered=True).collect()
    assert [r.c1 for r in got] == [str(k) if k % 4 else "" for k in range(25) if k % 5 == 3]
    assert equi_filter(table, "c1", "", []).first().n == 7
    assert equi_filter(table, "c0", "V3").count() == 0
    assert equi_filter(table, "c0", "v3 ").count() == 0


def test_filter_reaches_the_reader(spark, small, capsys):
    orders = Table(spark.read.parquet(f"{small}/orders.parquet"), "o_orderkey")
    equi_filter(orders, "o_orderpriority", "5-LOW", ["o_orderkey"]).explain("formatted")
    said = capsys.readouterr().out
    assert "EqualTo(o_orderpriority,5-LOW)" in said
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in said


def test_page_counts_keep_empty_pages(table):
    got = {r.page: r.n for r in equi_page_counts(table, "c1", "3").collect()}
    assert got == {0: 1, 1: 0, 2: 0}


def test_lookup_keeps_order_and_repeats(spark, table):
    wanted = [24, 3, 3, 0, 99, -1, 10]
    got = lookup(table, wanted, ["c0"])
    assert [(r.req_pos, r.c0) for r in got.collect()] == [(0, "v4"), (1, "v3"), (2, "v3"), (3, "v0"), (6, "v0")]
    asked = spark.createDataFrame([(5, 2), (7, 2)], "req_pos long, rid long")
    assert [tuple(r) for r in lookup(table, asked, ["c0"]).collect()] == [(5, "v2"), (7, "v2")]
    assert lookup(table, [], ["c0"]).count() == 0


def test_batches_follow_pages(table):
    got = list(batches(table, ["c0"]))
    assert [len(b) for b in got] == [10, 10, 5]
    assert got[2][0].c0 == "v0"


def test_formatted(table):
    assert formatted(scan(table, ["c0", "c1"], ordered=True)).first().line == "v0|"


def test_not_a_dataset(spark, tmp_path):
    (tmp_path / "x.parquet").write_text("no dataset at all")
    with pytest.raises(Exception):
        Table.open(spark, str(tmp_path / "x.parquet")).df.count()


def test_cli(spark, tmp_path):
    (tmp_path / "in.csv").write_text("".join(f"{k},{k % 3},x\n" for k in range(50)))
    out = io.StringIO()
    folder = str(tmp_path / "out")
    for line in (f"C {tmp_path}/in.csv {folder} 10 20 0,1", f"F {folder} 1 2 count", f"R {folder} 15,1 0", f"S {folder} 1", "X"):
        assert cli.run(spark, line, out)
    assert not cli.run(spark, "Q", out)
    said = out.getvalue()
    assert "ingested 20 rows" in said
    assert "7 rows" in said
    assert "25\n11\n2 rows" in said
