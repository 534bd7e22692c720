"""The equality filter and page counts over a stream of new files, as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.table import Table, equi_filter, equi_page_counts


def opened(spark: SparkSession, folder: str, schema: StructType, rid: str = "rid", page_size: int = 65_535) -> Table:
    """A table whose rows are the Parquet files that a folder has and gets."""
    return Table(spark.readStream.schema(schema).parquet(folder), rid, page_size)


def filtered(table: Table, column: str, value: str, columns: list[str] | None = None) -> DataFrame:
    return equi_filter(table, column, value, columns)


def counted(table: Table, column: str, value: str) -> DataFrame:
    """Matches of each page so far; its state has a row for each page."""
    return equi_page_counts(table, column, value)


def to_memory(rows: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    return rows.writeStream.format("memory").queryName(name).outputMode(mode).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n): rows in tumbling windows of event time; a window closes once rows as late as ``late`` have passed."""
    rows = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", width), F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "key", "n")
