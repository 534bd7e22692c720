"""Comma-delimited text as a source, and a paged, row-numbered Parquet dataset as its sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in a page.
PAGE_SIZE = 65_535
#: File splits whose table is sent to every task; beyond that it is joined by a shuffle.
BROADCAST_SPLITS = 50_000


def parse_columns(text: str) -> list[int]:
    """``"0,2"`` -> [0, 2]; the word ``count`` ends the list, so that on its own it asks for no columns."""
    out = []
    for part in text.split(","):
        if part.strip() == "count":
            break
        out.append(int(part))
    return out


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(rid, value): the lines of a text file, or of the files of a folder in name order, numbered from 0.

    A file split's lines are consecutive in one partition, so a line's number is the lines in the splits before, a table
    with a row for each split, and its place in its own. Up to BROADCAST_SPLITS splits, no line is shuffled. Nothing runs yet.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    placed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = placed.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")
    starts = splits.select("file", "block", (before - F.col("first")).alias("shift"))
    if len(lines.inputFiles()) + lines.rdd.getNumPartitions() <= BROADCAST_SPLITS:  # a split begins with a file or a partition
        starts = F.broadcast(starts)
    return placed.join(starts, ["file", "block"]).select((F.col("id") + F.col("shift")).alias("rid"), "value")


def field(line: Column, i: int) -> Column:
    """Field ``i`` of a line: split at commas without quoting, one closing carriage return dropped, missing ones empty."""
    return F.coalesce(F.get(F.split(F.regexp_replace(line, "\r$", ""), ",", -1), F.lit(i)), F.lit(""))


def fields(lines: DataFrame, columns: Sequence[int]) -> DataFrame:
    """``rid`` and the chosen fields, in the order asked for, renumbered c0, c1, ..."""
    return lines.select("rid", *(field(F.col("value"), c).alias(f"c{k}") for k, c in enumerate(columns)))


def window(rows: DataFrame, init: int = 0, count: int | None = None, rid: str = "rid") -> DataFrame:
    """The rows from number ``init`` on, ``count`` of them at most, numbered from 0 again."""
    if init < 0 or (count is not None and count < 0):
        raise ValueError("a row window can't be negative")
    kept = rows.where(F.col(rid) >= init)
    if count is not None:
        kept = kept.where(F.col(rid) < init + count)
    return kept.withColumn(rid, F.col(rid) - init)


def ingest(spark: SparkSession, path: str, out: str, init: int = 0, count: int | None = None, columns: Sequence[int] = (0,), compression: str = "snappy", row_group_bytes: int = 128 << 20) -> int:
    """Write the chosen columns of a row window as a dataset and return its number of rows.

    Partitions stay in file order and rows in it within them, so that row groups cover ranges of ``rid``.
    """
    rows = fields(window(numbered_lines(spark, path), init, count), columns)
    ordered = rows.sortWithinPartitions("rid")
    ordered.write.mode("overwrite").option("compression", compression).option("parquet.block.size", str(row_group_bytes)).parquet(out)
    return spark.read.parquet(out).count()
