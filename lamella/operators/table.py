"""Tables with row numbers, and what can be asked of them: scans, equality filters and look-ups.

Values compare as bytes: an equality filter takes a text and its column is compared as text. Order and repeats are kept
where they are part of a result, by explicit columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.text import PAGE_SIZE

#: Row numbers in a look-up up to which the scan gets them as a pushed-down list.
PUSHED_ROWS = 1_000


@dataclass(frozen=True)
class Table:
    """Rows with a column ``rid`` that numbers them from 0, in pages of ``page_size`` rows."""

    df: DataFrame
    rid: str = "rid"
    page_size: int = PAGE_SIZE

    @classmethod
    def open(cls, spark: SparkSession, path: str, rid: str = "rid", page_size: int = PAGE_SIZE) -> Table:
        """A stored dataset; what is no Parquet raises when its footer is read."""
        return cls(spark.read.parquet(path), rid, page_size)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != self.rid]

    def names(self, columns: Sequence[str | int] | None) -> list[str]:
        """Columns by name or position; an unknown one raises."""
        own = self.columns
        if columns is None:
            return own
        found = [own[c] if isinstance(c, int) and 0 <= c < len(own) else c for c in columns]
        if wrong := [c for c in found if c not in self.df.columns]:
            raise ValueError(f"no column {wrong} among {own}")
        return found

    def projected(self, columns: Sequence[str | int] | None) -> list[Column]:
        """Any order; a column that is asked for again gets a number behind its name."""
        names, out = self.names(columns), []
        for k, name in enumerate(names):
            again = names[:k].count(name)
            out.append(F.col(name).alias(f"{name}_{again}" if again else name))
        return out

    def cached(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Table:
        """The same rows, kept after they are first read; ``df.unpersist()`` lets them go."""
        return Table(self.df.persist(level), self.rid, self.page_size)

    def page(self) -> Column:
        return F.expr(f"`{self.rid}` div {self.page_size}")

    def slot(self) -> Column:
        return F.expr(f"`{self.rid}` % {self.page_size}").cast("long")


def scan(table: Table, columns: Sequence[str | int] | None = None, ordered: bool = False) -> DataFrame:
    """The chosen columns of every row; ``ordered`` by row number where that matters. No columns: the number of rows."""
    if columns is not None and not columns:
        return table.df.agg(F.count("*").alias("n"))
    rows = table.df.orderBy(table.rid) if ordered else table.df
    return rows.select(*table.projected(columns))


def matches(table: Table, column: str | int, value: str) -> Column:
    """Whether a row's column is ``value``, as text. A text column's filter reaches the Parquet reader."""
    name = table.names([column])[0]
    own = F.col(name)
    return (own if dict(table.df.dtypes)[name] == "string" else own.cast("string")) == F.lit(value)


def equi_filter(table: Table, column: str | int, value: str, columns: Sequence[str | int] | None = None, ordered: bool = False) -> DataFrame:
    """The rows whose column equals a text; the column itself need not be among the chosen. No columns: their number."""
    kept = Table(table.df.where(matches(table, column, value)), table.rid, table.page_size)
    return scan(kept, columns, ordered)


def equi_page_counts(table: Table, column: str | int, value: str) -> DataFrame:
    """(page, n): the matches of each page, pages without any included."""
    hit = F.when(matches(table, column, value), 1).otherwise(0)
    return table.df.groupBy(table.page().alias("page")).agg(F.sum(hit).alias("n"))


def page_counts(table: Table) -> DataFrame:
    """(page, n): the rows of each page."""
    return table.df.groupBy(table.page().alias("page")).agg(F.count("*").alias("n"))


def requests(spark: SparkSession, rids: Sequence[int]) -> DataFrame:
    """(req_pos, rid) of a list of row numbers, as a local relation whose size Spark knows."""
    return spark.createDataFrame(pa.table({"req_pos": pa.array(range(len(rids)), pa.int64()), "rid": pa.array([int(r) for r in rids], pa.int64())}))


def lookup(table: Table, rids: Sequence[int] | DataFrame, columns: Sequence[str | int] | None = None) -> DataFrame:
    """``req_pos`` and the chosen columns of each row asked for, in the order asked; repeats give repeats, and row numbers
    that don't exist nothing.

    ``rids`` is a list, or a table (req_pos, rid). A short list goes down to the scan, where it skips row groups.
    """
    rows = table.df.withColumnRenamed(table.rid, "_rid")
    few = not isinstance(rids, DataFrame) and len(rids) <= PUSHED_ROWS
    if not isinstance(rids, DataFrame):
        if few:
            rows = rows.where(F.col("_rid").isin([int(r) for r in set(rids)]))
        rids = requests(table.df.sparkSession, rids)
    named = Table(rows, "_rid", table.page_size)
    asked = rids.select("req_pos", F.col("rid").alias("_asked"))
    chosen = [c for c in named.projected(columns)]
    found = asked.join(rows, asked["_asked"] == rows["_rid"]).select("req_pos", *chosen)
    return found.repartition(1).sortWithinPartitions("req_pos") if few else found.orderBy("req_pos")


def lookup_batches(spark: SparkSession, rids: Sequence[int], page_size: int = PAGE_SIZE) -> DataFrame:
    """(batch, page, n): runs of consecutive requests for one page, in order. The list is the driver's, so one task numbers it."""
    page = F.expr(f"rid div {page_size}")
    order = Window.orderBy("req_pos")
    runs = requests(spark, rids).withColumn("page", page).withColumn("new", F.when(F.lag("page").over(order) == F.col("page"), 0).otherwise(1))
    return runs.withColumn("batch", F.sum("new").over(order) - 1).groupBy("batch", "page").agg(F.count("*").alias("n"))


def batches(table: Table, columns: Sequence[str | int] | None = None) -> Iterator[list[Row]]:
    """Rows page by page, pulled as they are asked for: one page is held at a time."""
    held: list[Row] = []
    last = None
    paged = table.df.orderBy(table.rid).select(table.page().alias("_page"), *table.projected(columns))
    for row in paged.toLocalIterator(prefetchPartitions=True):
        if last is not None and row["_page"] != last:
            yield held
            held = []
        last = row["_page"]
        held.append(Row(**{k: v for k, v in row.asDict().items() if k != "_page"}))
    if held:
        yield held


def formatted(rows: DataFrame, separator: str = "|") -> DataFrame:
    """(line): each row's values joined by a separator; nulls are empty."""
    return rows.select(F.concat_ws(separator, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns)).alias("line"))
