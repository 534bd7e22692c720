import pytest

from lamella.sources.text import fields, ingest, numbered_lines, parse_columns, window

LINES = {"a,b,c": ["a", "b", "c"], "a,b,c\r": ["a", "b", "c"], "only": ["only", "", ""], "1,,x": ["1", "", "x"], "a,b,": ["a", "b", ""], "": ["", "", ""], '"q,r",s': ['"q', 'r"', "s"], "é, ,ü": ["é", " ", "ü"]}


@pytest.fixture
def file(tmp_path):
    def write(lines, name="in.csv"):
        (tmp_path / name).write_bytes("".join(f"{x}\n" for x in lines).encode())
        return str(tmp_path / name)

    return write


def test_fields(spark, file):
    got = fields(numbered_lines(spark, file(LINES)), [0, 1, 2]).orderBy("rid").collect()
    assert [list(r)[1:] for r in got] == list(LINES.values())
    assert [r.rid for r in got] == list(range(len(LINES)))


def test_numbering_over_splits(spark, file):
    path = file([f"{k},{k % 7}" for k in range(20_000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = fields(numbered_lines(spark, path), [0])
        assert rows.rdd.getNumPartitions() > 4
        assert rows.where("cast(c0 as long) != rid").count() == 0
        assert rows.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(("n", "init", "count", "wanted"), [(30, 10, 20, range(10, 30)), (5, 2, 100, range(2, 5)), (5, 0, 0, []), (5, 9, 3, []), (4, 0, None, range(4))])
def test_window(spark, file, n, init, count, wanted):
    rows = fields(window(numbered_lines(spark, file(map(str, range(n)))), init, count), [0]).orderBy("rid").collect()
    assert [(r.rid, r.c0) for r in rows] == [(k, str(v)) for k, v in enumerate(wanted)]


def test_negative_window(spark, file):
    with pytest.raises(ValueError):
        window(numbered_lines(spark, file(["a"])), -1, 2)


def test_ingest_reorders_and_overwrites(spark, file, tmp_path):
    out = str(tmp_path / "out")
    path = file(["a,b,c", "d,e,f", "g"])
    assert ingest(spark, path, out, 0, 100, [0]) == 3
    assert ingest(spark, path, out, 1, 100, [2, 0, 2]) == 2
    assert [tuple(r) for r in spark.read.parquet(out).orderBy("rid").collect()] == [(0, "f", "d", "f"), (1, "", "g", "")]


def test_parse_columns():
    assert parse_columns("0,1") == [0, 1]
    assert parse_columns("count") == []
    assert parse_columns("3,count,9") == [3]
