import datetime as dt

from lamella.streaming import filters


def test_filter_over_new_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(k, "a" if k % 3 else "b") for k in range(30)], "rid long, v string").write.parquet(folder)
    table = filters.opened(spark, folder, spark.read.parquet(folder).schema, page_size=10)
    query = filters.to_memory(filters.filtered(table, "v", "b", ["rid"]), "found")
    counts = filters.to_memory(filters.counted(table, "v", "b"), "counts", "complete")
    try:
        query.processAllAvailable()
        spark.createDataFrame([(30, "b")], "rid long, v string").write.mode("append").parquet(folder)
        query.processAllAvailable()
        counts.processAllAvailable()
    finally:
        query.stop()
        counts.stop()
    assert sorted(r.rid for r in spark.table("found").collect()) == [*range(0, 30, 3), 30]
    assert {r.page: r.n for r in spark.table("counts").collect()} == {0: 4, 1: 3, 2: 3, 3: 1}


def test_windows_are_the_same_in_a_batch(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(at + dt.timedelta(minutes=25 * k), "x") for k in range(5)], "t timestamp, k string")
    got = filters.windowed_counts(rows, "t", "k").orderBy("start").collect()
    assert [r.n for r in got] == [3, 2]
