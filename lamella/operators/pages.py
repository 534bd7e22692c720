"""Statistics of pages: distinct values, zone maps, first occurrences and the ratios that decide an encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import code_width
from .table import Table

#: Over this share of distinct values a page is stored plainly; over this share of new ones its dictionary starts afresh.
PLAIN_RATIO, NEW_RATIO = 0.80, 0.99


def _rows(table: Table, column: str) -> DataFrame:
    """(page, v): each row's page and value, as text."""
    return table.df.select(table.page().alias("page"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("v"))


def distinct_values(table: Table, column: str) -> DataFrame:
    """(page, v, n): each page's distinct values and their rows. The base of the statistics: it is as small as they allow."""
    return _rows(table, column).groupBy("page", "v").agg(F.count("*").alias("n"))


def stats(table: Table, column: str) -> DataFrame:
    """(page, n_rows, n_distinct, min_v, max_v, is_plain, width) of each page."""
    pages = distinct_values(table, column).groupBy("page").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))
    return pages.withColumn("is_plain", is_plain(F.col("n_distinct"), F.col("n_rows"))).withColumn("width", code_width(F.col("n_distinct")))


def is_plain(distinct: Column, rows: Column) -> Column:
    return distinct / rows > PLAIN_RATIO


def sorted_values(table: Table, column: str) -> DataFrame:
    """(page, values): each page's dictionary, sorted; at most a page's rows."""
    return distinct_values(table, column).groupBy("page").agg(F.array_sort(F.collect_list("v")).alias("values"))


def first_pages(table: Table, column: str) -> DataFrame:
    """(v, first_page): where each value occurs first."""
    return _rows(table, column).groupBy("v").agg(F.min("page").alias("first_page"))


def new_values(table: Table, column: str) -> DataFrame:
    """(page, n_distinct, n_new, new_ratio, min_new, max_new): values that no earlier page holds; a blank where none is new."""
    own = distinct_values(table, column)
    # Found among the pages' distinct values, whose shuffle both sides use.
    fresh = own.groupBy("v").agg(F.min("page").alias("page")).groupBy("page").agg(F.count("*").alias("n_new"), F.min("v").alias("min_new"), F.max("v").alias("max_new"))
    pages = own.groupBy("page").agg(F.count("*").alias("n_distinct")).join(fresh, "page", "left")
    n_new = F.coalesce("n_new", F.lit(0)).cast("long")
    return pages.select("page", "n_distinct", n_new.alias("n_new"), (n_new / F.col("n_distinct")).alias("new_ratio"), F.coalesce("min_new", F.lit(" ")).alias("min_new"), F.coalesce("max_new", F.lit(" ")).alias("max_new"))


def zone_pruned(table: Table, column: str, value: str) -> DataFrame:
    """(page): the pages whose bounds let them hold ``value``."""
    return stats(table, column).where((F.col("min_v") <= value) & (F.col("max_v") >= value)).select("page")


def local_codes(table: Table, column: str) -> DataFrame:
    """(page, v, code): codes of a dictionary of each page's own, in order of values."""
    order = Window.partitionBy("page").orderBy("v")
    return distinct_values(table, column).select("page", "v", (F.row_number().over(order) - 1).cast("long").alias("code"))


def growing_codes(table: Table, column: str) -> DataFrame:
    """(v, first_page, code): codes of one dictionary to which each page appends its new values, sorted.

    A value's code is the new values of earlier pages, one running sum over pages, and its rank within its own.
    """
    first = first_pages(table, column)
    lens = first.groupBy("first_page").agg(F.count("*").alias("len"))
    before = lens.select("first_page", (F.sum("len").over(Window.orderBy("first_page")) - F.col("len")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("first_page").orderBy("v")) - 1
    return first.withColumn("rank", rank).join(before, "first_page").select("v", "first_page", (F.col("base") + F.col("rank")).cast("long").alias("code"))


def chain(table: Table, column: str) -> DataFrame:
    """(page, len, base): the segment that each page adds to a growing dictionary and where it begins."""
    lens = new_values(table, column).select("page", F.col("n_new").alias("len"))
    return lens.select("page", "len", (F.sum("len").over(Window.orderBy("page")) - F.col("len")).cast("long").alias("base"))


def shared_ratio(table: Table, column: str) -> DataFrame:
    """(page, ratio): the share of a page's distinct values that the page before holds as well."""
    own = distinct_values(table, column).select("page", "v")
    earlier = own.select((F.col("page") + 1).alias("page"), "v", F.lit(1).alias("again"))
    return own.join(earlier, ["page", "v"], "left").groupBy("page").agg((F.count("again") / F.count("*")).alias("ratio"))
