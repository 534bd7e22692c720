"""Beyond look-ups: predicates, joins, sorts, aggregates, windows and set operations over numbered tables, left to Catalyst to plan.

Joins carry no broadcast hint: Spark sends a side to all tasks only when its measured size is under its limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .table import Table


def range_filter(table: Table, column: str | int, low: str | None = None, high: str | None = None, columns: Sequence[str | int] | None = None) -> DataFrame:
    """Rows whose column, as text, lies from ``low`` to ``high``, both included; an open end is None."""
    name = table.names([column])[0]
    own = F.col(name) if dict(table.df.dtypes)[name] == "string" else F.col(name).cast("string")
    kept = table.df
    if low is not None:
        kept = kept.where(own >= F.lit(low))
    if high is not None:
        kept = kept.where(own <= F.lit(high))
    return Table(kept, table.rid, table.page_size).df.select(*table.projected(columns))


def join(left: Table, right: Table, on: Sequence[tuple[str, str]], how: str = "inner", columns: Sequence[str] | None = None) -> DataFrame:
    """An equality join of two tables: inner, left, right, full, left_semi or left_anti. A skewed key is split by AQE."""
    condition = None
    for a, b in on:
        one = left.df[a] == right.df[b]
        condition = one if condition is None else condition & one
    rows = left.df.join(right.df, condition, how)
    return rows if columns is None else rows.select(*columns)


def sort(table: Table, by: Sequence[str], descending: bool = False, limit: int | None = None) -> DataFrame:
    """Rows in order of columns, then of row numbers, so that ties keep their order; with ``limit``, the first ones only."""
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in by] + [F.col(table.rid).asc()]
    rows = table.df.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def aggregate(table: Table, by: Sequence[str], totals: Sequence[Column], sets: str = "group") -> DataFrame:
    """Aggregates by columns; ``sets`` is group, rollup or cube. No columns: one row for the whole table."""
    if not by:
        return table.df.agg(*totals)
    grouped = {"group": table.df.groupBy, "rollup": table.df.rollup, "cube": table.df.cube}[sets](*by)
    return grouped.agg(*totals)


def where(table: Table, condition: Column | str, columns: Sequence[str | int] | None = None) -> DataFrame:
    """Rows that meet any condition, a column or SQL: AND, OR, NOT, IN, LIKE, IS NULL, CASE. Parquet gets what it can use."""
    return table.df.where(condition).select(*table.projected(columns))


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """The rows of ``left`` with the ``values`` of the last row of ``right`` of equal ``on`` at or before their ``time``.

    Both sides form one sequence by key and time, along which the last values seen are carried: one shuffle by key and a
    sort, no pairs. A key's rows are walked by one task, which holds none of them.
    """
    own = [c for c in left.columns if c not in on and c != time]
    seen = F.struct(*(F.col(v) for v in values))
    a = left.select(*on, time, F.struct(*own).alias("_row"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(seen.alias("s")).schema["s"].dataType).alias("_seen"))
    b = right.select(*on, time, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.lit(0).alias("_side"), seen.alias("_seen"))
    order = Window.partitionBy(*on).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.union(b).withColumn("_seen", F.last("_seen", ignorenulls=True).over(order)).where("_side = 1")
    return carried.select(*on, time, *(F.col(f"_row.{c}").alias(c) for c in own), *(F.col(f"_seen.{v}").alias(v) for v in values))


def interval_join(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, cell: int) -> DataFrame:
    """Pairs of a point and an interval with low <= at < high, for integers.

    Intervals are laid into the cells of ``cell`` numbers that they touch and points into theirs, so that an equality join
    finds the pairs, each once; cells should be about as wide as intervals are.
    """
    cells = F.sequence(F.expr(f"floor({low} / {cell})"), F.expr(f"floor(({high} - 1) / {cell})"))
    laid = intervals.where(F.col(low) < F.col(high)).select("*", F.explode(cells).alias("_cell"))
    return points.withColumn("_cell", F.expr(f"floor({at} / {cell})")).join(laid, "_cell").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_cell")


def ranked(table: Table, by: Sequence[str], order: Sequence[Column], most: int | None = None) -> DataFrame:
    """The rows with ``rank``, their place among those of equal ``by``, ties in order of row numbers; the first ``most``
    of each only, if given, of which Spark then keeps no more while it sorts."""
    rows = table.df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order, F.col(table.rid))))
    return rows if most is None else rows.where(F.col("rank") <= most)


def set_operation(a: DataFrame, b: DataFrame, kind: str, repeats: bool = False) -> DataFrame:
    """union, intersect or except of rows; ``repeats`` keeps as many equal rows as SQL's ALL does."""
    made = {"union": (lambda: a.unionByName(b).distinct(), lambda: a.unionByName(b)), "intersect": (lambda: a.intersect(b), lambda: a.intersectAll(b)), "except": (lambda: a.subtract(b), lambda: a.exceptAll(b))}
    return made[kind][repeats]()


def sample(table: Table, share: float, seed: int = 0) -> DataFrame:
    """About a share of the rows, chosen by a hash of the row number, so that the same rows come every time."""
    lot = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(table.rid).cast("string"))), 1, 8), 16, 10).cast("long")
    return table.df.where(lot < int(share * (1 << 32)))
