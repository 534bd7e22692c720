"""Serialized forms, custom types, constant pages, look-ups on encoded pages, caching, as-of and interval joins."""

import pytest
from pyspark.sql import functions as F

from lamella.functions import codec
from lamella.operators import encoding, relational
from lamella.operators.table import Table, equi_filter, requests
from lamella.session import scratch
from lamella.sources import typed


def varint(n):
    out = []
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def test_varints(spark):
    numbers = [0, 1, 127, 128, 300, 16_383, 16_384, (1 << 31) - 1, 1 << 31, (1 << 56) - 1, 1 << 56, (1 << 63) - 1]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", codec.varint_encode(F.col("n")).alias("raw")).withColumn("back", codec.varint_decode(F.col("raw")))
    for r in rows.collect():
        assert bytes(r.raw) == varint(r.n)
        assert (r.back.value, r.back.next) == (r.n, len(r.raw))


def test_lists_of_texts(spark):
    lists = [[], [""], ["a", "é😀", "x" * 300], ["b"] * 200]
    rows = spark.createDataFrame([(v,) for v in lists], "v array<string>").select("v", codec.list_encode(F.col("v")).alias("raw"))
    for r in rows.select("v", "raw", codec.list_decode(F.col("raw")).alias("back"), codec.list_bytes(F.col("v")).alias("size")).collect():
        assert bytes(r.raw) == varint(len(r.v)) + b"".join(varint(len(x.encode())) + x.encode() for x in r.v)
        assert r.back == r.v
        assert r.size == len(r.raw)


def test_custom_types(spark):
    """A point that keeps its coordinates as one text."""
    point = typed.Custom(lambda p: F.struct(F.split(p, ";")[0].cast("double").alias("x"), F.split(p, ";")[1].cast("double").alias("y")), "struct<x:double,y:double>", lambda s: F.concat_ws(";", s["x"], s["y"]))
    rows = spark.createDataFrame([("1.5;2.0",), ("-3.0;0.25",)], "p string").select("p", point.from_bytes(point.to_bytes(F.col("p"))).alias("back"))
    assert all(r.p == r.back for r in rows.collect())


def test_maps_of_any_type(spark):
    rows = spark.createDataFrame([([("a", 1.5), ("b", 2.0), ("a", 3.0)],), ([],)], "p array<struct<key:string,value:double>>")
    assert [r.m for r in rows.select(typed.as_map(F.col("p")).alias("m")).collect()] == [{"a": 3.0, "b": 2.0}, {}]


def paged(spark, values, page=4):
    return Table(spark.createDataFrame(list(enumerate(values)), "rid long, c string"), "rid", page)


VALUES = ["x"] * 8 + ["x", "y", "x", "y"] + ["p", "q", "r", "s"] + ["y"] * 3


def test_constant_pages(spark):
    table = paged(spark, VALUES)
    coded = encoding.encode(table, ["c"], run_pages=None)
    for value in ("x", "y", "q", "none", ""):
        assert sorted(r.rid for r in encoding.filter_codes(coded, "c", value, 4).collect()) == [k for k, v in enumerate(VALUES) if v == value]
    # A constant page matches without a look at its codes.
    blind = coded.withColumn("codes", F.when(F.col("min_v") != F.col("max_v"), F.col("codes")))
    assert sorted(r.rid for r in encoding.filter_codes(blind, "c", "x", 4).collect()) == [k for k, v in enumerate(VALUES) if v == "x"]


def test_look_up_on_codes(spark):
    table = paged(spark, VALUES)
    coded = encoding.encode(table, ["c"], run_pages=2)
    wanted = [18, 0, 0, 13, 9, 19, 400, -1, 16]
    got = sorted((r.req_pos, r.v) for r in encoding.lookup_codes(coded, requests(spark, wanted), 4).collect())
    assert got == [(k, VALUES[r]) for k, r in enumerate(wanted) if 0 <= r < len(VALUES)]


def test_cached_tables_give_the_same(spark):
    table = paged(spark, VALUES)
    kept = table.cached()
    try:
        for _ in range(2):
            assert equi_filter(kept, "c", "x", []).collect() == equi_filter(table, "c", "x", []).collect()
        assert kept.df.storageLevel.useMemory
    finally:
        kept.df.unpersist()


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, "c"), (None, 5, "d"), (1, 4, "e")], "k int, t int, x string")
    right = spark.createDataFrame([(1, 5, 50), (1, 8, 80), (2, 2, 20), (1, 5, None)], "k int, t int, v int").where("v is not null")
    got = {(r.x, r.v) for r in relational.as_of(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {("a", 50), ("b", 80), ("c", None), ("d", None), ("e", None)}


def test_interval_join(spark):
    points = [-7, 0, 3, 9, 10, 25]
    intervals = [(0, 10, "a"), (-8, -7, "b"), (-7, 4, "c"), (3, 3, "empty"), (9, 26, "d")]
    rows = relational.interval_join(spark.createDataFrame([(p,) for p in points], "p int"), "p", spark.createDataFrame(intervals, "lo int, hi int, n string"), "lo", "hi", 4)
    assert sorted((r.p, r.n) for r in rows.collect()) == sorted((p, n) for p in points for lo, hi, n in intervals if lo <= p < hi)


@pytest.mark.parametrize(("kind", "repeats", "wanted"), [("union", True, [1, 1, 2, 2, 3]), ("union", False, [1, 2, 3]), ("intersect", True, [2]), ("except", True, [1, 1]), ("except", False, [1])])
def test_set_operations(spark, kind, repeats, wanted):
    a, b = (spark.createDataFrame([(x,) for x in v], "x int") for v in ([1, 1, 2], [2, 3]))
    assert sorted(r.x for r in relational.set_operation(a, b, kind, repeats).collect()) == wanted


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Session:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        scratch(Session, "x")
    assert scratch(spark, "x") != scratch(spark, "x")
