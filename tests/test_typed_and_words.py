import pytest
from pyspark.sql import functions as F

from lamella.operators import bloom
from lamella.sources import typed, words

SHAPE = "struct<i:int,l:bigint,d:double,b:boolean,s:string,a:array<int>,bits:array<boolean>,opt:array<int>,grid:array<array<int>>,m:map<string,int>,pair:struct<first:string,second:int>,rows:array<struct<num:int,vec:array<double>,str:string>>>"
VALUES = [
    (0, 0, 0.0, True, "", [], [], [], [], {}, ("aa", 3), []),
    (2**31 - 1, 2**63 - 1, 3.3, False, "test", [3, 444, -33], [True, False, True], [1, None, None, 4], [[4, 44], [0]], {"aa": 33, "bb": 0, "cc": -333}, ("é", -1), [(3, [2.2, -4.4], "aa")]),
    (-(2**31), -7363025924956902506, -4.4, None, None, None, [k % 3 == 0 for k in range(1024)], [k if k % 3 == 0 else None for k in range(1024)], None, None, None, None),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(k, v) for k, v in enumerate(VALUES)], f"k int, v {SHAPE}")


def test_text_and_bytes(table):
    v = F.col("v")
    got = table.select("v", typed.from_text(typed.to_text(v), SHAPE).alias("t"), typed.from_bytes(typed.to_bytes(v), SHAPE).alias("b")).collect()
    assert len(got) == 3
    for r in got:
        assert r.v == r.t == r.b


@pytest.mark.parametrize(("form", "codec"), [("parquet", "snappy"), ("parquet", "zstd"), ("orc", "zlib")])
def test_files(spark, table, tmp_path, form, codec):
    typed.write(table, str(tmp_path / "t"), form, codec)
    back = typed.read(spark, str(tmp_path / "t"), table.schema, form)
    assert {r.k: r.v for r in back.collect()} == {r.k: r.v for r in table.collect()}


def test_sets_and_maps(spark):
    rows = spark.createDataFrame([([3, 0, -133, 3], [("aa", 1), ("bb", 0), ("aa", 33)]), ([], [])], "v array<int>, p array<struct<key:string,value:bigint>>")
    got = rows.select(typed.as_set(F.col("v")).alias("s"), typed.as_map(F.col("p")).alias("m")).collect()
    assert [(r.s, r.m) for r in got] == [([-133, 0, 3], {"aa": 33, "bb": 0}), ([], {})]


def test_word_lists(spark, tmp_path):
    (tmp_path / "words.txt").write_text("apple\nbee\n\n level \napple\n")
    own = words.load_words(spark, str(tmp_path / "words.txt"), upper=True)
    assert {r.word for r in own.collect()} == {"apple", "bee", "level", "APPLE", "BEE", "LEVEL"}
    others = words.outliers(own)
    assert others.join(own, "word").count() == 0
    assert others.count() >= 20
    p = bloom.optimal(6, 1 / 100)
    built = bloom.build(own, "word", p)
    assert bloom.contains(own, "word", built, p).where("not found").count() == 0


def test_lines(spark, tmp_path):
    typed.write_lines(spark.createDataFrame([("a|b",), ("",)], "line string"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["", "a|b"]
