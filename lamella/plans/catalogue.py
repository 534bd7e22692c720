"""The named queries over the star-schema tables, each with the SQL that must give the same rows.

``P`` is the page size: small, so that a small table has several pages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import codec
from ..operators import bloom, encoding, pages, relational
from ..operators.table import Table, equi_filter, equi_page_counts, formatted, lookup, lookup_batches, page_counts, requests, scan
from ..session import scratch
from ..sources import typed
from ..sources.text import field, ingest, parse_columns, window

P = 1024
#: Requests for look-ups: unsorted, with repeats, changing pages, with first and last rows of pages and one that is none.
WANTED = [15, 100, 15, 1023, 1024, 2047, 3, 900, 901, 1400, 5, 10_000_000]
BLOOM = bloom.optimal(1_000, 0.01, portable=True)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@lru_cache(maxsize=256)
def _schema(spark: SparkSession, path: str) -> StructType:
    """A table's columns, read from its footer once in a session."""
    return spark.read.parquet(path).schema


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def orders(spark: SparkSession, sf_dir: str) -> Table:
    return Table(_read(spark, sf_dir, "orders"), "o_orderkey", P)


def events(spark: SparkSession, sf_dir: str) -> Table:
    return Table(_read(spark, sf_dir, "events"), "event_id", P)


def customers(spark: SparkSession, sf_dir: str) -> Table:
    return Table(_read(spark, sf_dir, "customer"), "c_custkey", 256)


# Scans and projections


@query("SELECT l_returnflag, l_linestatus FROM lineitem")
def scan_projection(spark, sf_dir):
    return scan(Table(_read(spark, sf_dir, "lineitem"), "l_orderkey"), ["l_returnflag", "l_linestatus"])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS c0, o_orderstatus AS c1, o_orderpriority AS c2, CAST(o_custkey AS VARCHAR) AS c3 FROM orders")
def scan_all_strings(spark, sf_dir):
    return orders(spark, sf_dir).df.select(*(F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(["o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"])))


@query("SELECT o_orderpriority, o_orderstatus, o_orderpriority AS o_orderpriority_1 FROM orders")
def scan_reorder_dup(spark, sf_dir):
    return scan(orders(spark, sf_dir), ["o_orderpriority", "o_orderstatus", "o_orderpriority"])


@query("SELECT count(*) AS n FROM orders")
def scan_count_only(spark, sf_dir):
    return scan(orders(spark, sf_dir), [])


@query(f"SELECT o_orderkey // {P} AS page, count(*) AS n FROM orders GROUP BY 1")
def scan_page_counts(spark, sf_dir):
    return page_counts(orders(spark, sf_dir))


# Equality filters


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_eq_low_card(spark, sf_dir):
    return equi_filter(orders(spark, sf_dir), "o_orderpriority", "1-URGENT", ["o_orderkey", "o_orderpriority"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000042'")
def filter_eq_high_card(spark, sf_dir):
    return equi_filter(customers(spark, sf_dir), "c_name", "Customer#000000042", ["c_custkey", "c_name"])


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '9-NONE'")
def filter_eq_absent(spark, sf_dir):
    return equi_filter(orders(spark, sf_dir), "o_orderpriority", "9-NONE", ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = ''")
def filter_eq_empty(spark, sf_dir):
    return equi_filter(orders(spark, sf_dir), "o_orderpriority", "", ["o_orderkey"])


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def filter_project_other(spark, sf_dir):
    return equi_filter(Table(_read(spark, sf_dir, "lineitem"), "l_orderkey"), "l_returnflag", "R", ["l_orderkey", "l_quantity"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_custkey AS VARCHAR) = '77'")
def filter_eq_as_text(spark, sf_dir):
    return equi_filter(orders(spark, sf_dir), "o_custkey", "77", ["o_orderkey", "o_custkey"])


@query("SELECT count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_count_only(spark, sf_dir):
    return equi_filter(orders(spark, sf_dir), "o_orderpriority", "1-URGENT", [])


@query(f"SELECT event_id // {P} AS page, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM events GROUP BY 1")
def filter_page_counts(spark, sf_dir):
    return equi_page_counts(events(spark, sf_dir), "event_type", "purchase")


# Look-ups by row number

_VALUES = ", ".join(f"({k}, {r})" for k, r in enumerate(WANTED))


@query(f"SELECT CAST(q.req_pos AS BIGINT) AS req_pos, o_orderstatus, o_orderpriority FROM (VALUES {_VALUES}) q(req_pos, rid) JOIN orders ON o_orderkey = q.rid")
def lookup_rows(spark, sf_dir):
    return lookup(orders(spark, sf_dir), WANTED, ["o_orderstatus", "o_orderpriority"])


@query("SELECT CAST(event_id AS BIGINT) AS req_pos, o_orderkey, o_orderpriority FROM events JOIN orders ON o_orderkey = user_id")
def lookup_by_table(spark, sf_dir):
    asked = _read(spark, sf_dir, "events").select(F.col("event_id").alias("req_pos"), F.col("user_id").alias("rid"))
    table = orders(spark, sf_dir)
    return lookup(Table(table.df.withColumn("rid", F.col("o_orderkey")), "rid", P), asked, ["o_orderkey", "o_orderpriority"])


@query("SELECT CAST(q.req_pos AS BIGINT) AS req_pos, event_type FROM (VALUES (0, 7), (1, 7), (2, 7)) q(req_pos, rid) JOIN events ON event_id = q.rid")
def lookup_duplicates(spark, sf_dir):
    return lookup(events(spark, sf_dir), [7, 7, 7], ["event_type"])


@query(f"""WITH q AS (SELECT req_pos, rid // {P} AS page FROM (VALUES {_VALUES}) q(req_pos, rid)),
m AS (SELECT *, CASE WHEN lag(page) OVER (ORDER BY req_pos) = page THEN 0 ELSE 1 END AS new FROM q),
r AS (SELECT *, sum(new) OVER (ORDER BY req_pos) - 1 AS batch FROM m)
SELECT CAST(batch AS BIGINT) AS batch, CAST(page AS BIGINT) AS page, count(*) AS n FROM r GROUP BY 1, 2""")
def lookup_batch_runs(spark, sf_dir):
    return lookup_batches(spark, WANTED, P)


@query(f"SELECT event_id, event_id // {P} AS page, event_id % {P} AS slot FROM events")
def rowid_page_slot(spark, sf_dir):
    table = events(spark, sf_dir)
    return table.df.select("event_id", table.page().alias("page"), table.slot().alias("slot"))


# Row windows and fields of text


@query("SELECT o_orderkey - 10 AS o_orderkey, o_orderpriority FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 30")
def offset_limit(spark, sf_dir):
    return window(_read(spark, sf_dir, "orders"), 10, 20, "o_orderkey").select("o_orderkey", "o_orderpriority")


_LINE = "concat_ws(',', CAST(o_orderkey AS VARCHAR), o_orderstatus, '', o_orderpriority)"


@query(f"SELECT o_orderkey AS rid, split_part({_LINE}, ',', 4) AS c0, split_part({_LINE}, ',', 1) AS c1, split_part({_LINE}, ',', 3) AS c2, split_part({_LINE}, ',', 9) AS c3 FROM orders")
def split_fields(spark, sf_dir):
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", F.lit(""), "o_orderpriority")
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rid"), *(field(line, c).alias(f"c{k}") for k, c in enumerate((3, 0, 2, 8))))


@query("SELECT count(DISTINCT event_id // 1024) AS pages FROM events")
def page_count(spark, sf_dir):
    table = events(spark, sf_dir)
    return page_counts(table).agg(F.count("*").alias("pages"))


@query("SELECT event_id // 1024 AS page, count(*) AS n FROM events GROUP BY 1")
def page_rows(spark, sf_dir):
    return page_counts(events(spark, sf_dir))


@query(f"SELECT CAST(row_number() OVER (ORDER BY q.req_pos) - 1 AS BIGINT) AS place, CAST(q.req_pos AS BIGINT) AS req_pos, o_orderkey FROM (VALUES {_VALUES}) q(req_pos, rid) JOIN orders ON o_orderkey = q.rid")
def lookup_ordered(spark, sf_dir):
    """The rows asked for come in the order asked: a short list's answer is one partition, whose rows are numbered as they come."""
    table = orders(spark, sf_dir)
    found = lookup(Table(table.df.withColumn("rid", F.col("o_orderkey")), "rid", P), WANTED, ["o_orderkey"])
    return found.select(F.monotonically_increasing_id().alias("place"), "req_pos", "o_orderkey")


_CSV = "concat_ws(',', CAST(o_orderkey AS VARCHAR), o_orderstatus, '', o_orderpriority, CAST(o_custkey AS VARCHAR))"


@query(f"SELECT o_orderkey - 7 AS rid, split_part({_CSV}, ',', 4) AS c0, split_part({_CSV}, ',', 1) AS c1, split_part({_CSV}, ',', 5) AS c2, split_part({_CSV}, ',', 3) AS c3, split_part({_CSV}, ',', 4) AS c4 FROM orders WHERE o_orderkey >= 7")
def ingest_text(spark, sf_dir):
    """All orders as delimited text files, from which a paged dataset is ingested, less its first 7 rows, and scanned."""
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", F.lit(""), "o_orderpriority", F.col("o_custkey").cast("string")).alias("value"))
    text, out = scratch(spark, "text"), scratch(spark, "table")
    typed.write_lines(rows.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select("value"), text)
    ingest(spark, text, out, 7, None, parse_columns("3,0,4,2,3"))
    return scan(Table.open(spark, out), ["rid", "c0", "c1", "c2", "c3", "c4"])


# Page statistics and encoding decisions


@query(f"SELECT page, string_agg(v, ',' ORDER BY v) AS vals FROM (SELECT DISTINCT event_id // {P} AS page, event_type AS v FROM events) GROUP BY 1")
def page_distinct_sorted(spark, sf_dir):
    return pages.sorted_values(events(spark, sf_dir), "event_type").select("page", F.concat_ws(",", "values").alias("vals"))


@query(f"SELECT o_orderkey // {P} AS page, min(CAST(o_custkey AS VARCHAR)) AS min_v, max(CAST(o_custkey AS VARCHAR)) AS max_v FROM orders GROUP BY 1")
def page_minmax(spark, sf_dir):
    return pages.stats(orders(spark, sf_dir), "o_custkey").select("page", "min_v", "max_v")


@query(f"SELECT o_orderkey // {P} AS page, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_distinct, count(DISTINCT o_custkey) * 1.0 / count(*) > 0.8 AS is_plain FROM orders GROUP BY 1")
def page_encoding_plain(spark, sf_dir):
    return pages.stats(orders(spark, sf_dir), "o_custkey").select("page", F.col("n_rows").cast("long").alias("n_rows"), F.col("n_distinct"), "is_plain")


@query(f"SELECT o_orderkey // {P} AS page, CAST(CASE WHEN count(DISTINCT o_custkey) < 256 THEN 1 WHEN count(DISTINCT o_custkey) < 65536 THEN 2 ELSE 4 END AS INTEGER) AS width FROM orders GROUP BY 1")
def code_width(spark, sf_dir):
    return pages.stats(orders(spark, sf_dir), "o_custkey").select("page", "width")


_FIRST = f"SELECT CAST(o_custkey AS VARCHAR) AS v, min(o_orderkey // {P}) AS first_page FROM orders GROUP BY 1"


@query(_FIRST)
def page_new_values(spark, sf_dir):
    return pages.first_pages(orders(spark, sf_dir), "o_custkey")


_DISTINCT = f"SELECT o_orderkey // {P} AS page, count(DISTINCT o_custkey) AS n_distinct FROM orders GROUP BY 1"


@query(f"""WITH f AS ({_FIRST}), d AS ({_DISTINCT}), n AS (SELECT first_page, count(*) AS k FROM f GROUP BY 1)
SELECT page, n_distinct, coalesce(k, 0) AS n_new, coalesce(k, 0) * 1.0 / n_distinct > 0.99 AS mostly_new FROM d LEFT JOIN n ON page = first_page""")
def page_new_ratio(spark, sf_dir):
    return pages.new_values(orders(spark, sf_dir), "o_custkey").select("page", "n_distinct", "n_new", (F.col("new_ratio") > pages.NEW_RATIO).alias("mostly_new"))


@query(f"""WITH f AS ({_FIRST}), n AS (SELECT first_page, min(v) AS lo, max(v) AS hi FROM f GROUP BY 1)
SELECT DISTINCT o_orderkey // {P} AS page, coalesce(lo, ' ') AS min_new, coalesce(hi, ' ') AS max_new FROM orders LEFT JOIN n ON o_orderkey // {P} = first_page""")
def segment_minmax(spark, sf_dir):
    return pages.new_values(orders(spark, sf_dir), "o_custkey").select("page", "min_new", "max_new")


@query(f"""WITH d AS (SELECT DISTINCT event_id // {P} AS page, event_type AS v FROM events),
l AS (SELECT page, v FROM d JOIN (SELECT page + 1 AS again, v AS w FROM d) e ON page = again AND v = w)
SELECT d.page, count(l.v) * 1.0 / count(*) > 0.2 AS shares FROM d LEFT JOIN l ON d.page = l.page AND d.v = l.v GROUP BY 1""")
def page_overlap(spark, sf_dir):
    return pages.shared_ratio(events(spark, sf_dir), "event_type").select("page", (F.col("ratio") > 0.2).alias("shares"))


@query(f"SELECT page, v, dense_rank() OVER (PARTITION BY page ORDER BY v) - 1 AS code FROM (SELECT DISTINCT event_id // {P} AS page, event_type AS v FROM events)")
def dict_codes_local(spark, sf_dir):
    return pages.local_codes(events(spark, sf_dir), "event_type")


@query(f"SELECT v, first_page, row_number() OVER (ORDER BY first_page, v) - 1 AS code FROM ({_FIRST})")
def dict_codes_diff(spark, sf_dir):
    return pages.growing_codes(orders(spark, sf_dir), "o_custkey")


@query(f"""WITH n AS (SELECT first_page, count(*) AS k FROM ({_FIRST}) GROUP BY 1), p AS (SELECT DISTINCT o_orderkey // {P} AS page FROM orders)
SELECT page, coalesce(k, 0) AS len, CAST(sum(coalesce(k, 0)) OVER (ORDER BY page) - coalesce(k, 0) AS BIGINT) AS base FROM p LEFT JOIN n ON page = first_page""")
def dict_chain(spark, sf_dir):
    return pages.chain(orders(spark, sf_dir), "o_custkey")


@query(f"SELECT o_orderkey // {P} AS page FROM orders GROUP BY 1 HAVING min(lpad(CAST(o_orderkey AS VARCHAR), 8, '0')) <= '00001500' AND max(lpad(CAST(o_orderkey AS VARCHAR), 8, '0')) >= '00001500'")
def zone_prune_pages(spark, sf_dir):
    table = orders(spark, sf_dir)
    keyed = Table(table.df.withColumn("k", F.lpad(F.col("o_orderkey").cast("string"), 8, "0")), table.rid, P)
    return pages.zone_pruned(keyed, "k", "00001500")


@query(f"""SELECT page, CAST(sum(b) + any_value(CASE WHEN k < 128 THEN 1 WHEN k < 16384 THEN 2 ELSE 3 END) AS BIGINT) AS bytes FROM (
SELECT page, strlen(v) + CASE WHEN strlen(v) < 128 THEN 1 WHEN strlen(v) < 16384 THEN 2 ELSE 3 END AS b, count(*) OVER (PARTITION BY page) AS k
FROM (SELECT DISTINCT event_id // {P} AS page, props AS v FROM events)) GROUP BY 1""")
def dict_serialized_bytes(spark, sf_dir):
    return pages.sorted_values(events(spark, sf_dir), "props").select("page", codec.list_bytes(F.col("values")).cast("long").alias("bytes"))


@query("SELECT 'orders' AS t, o_orderkey AS rid, o_orderpriority AS v FROM orders UNION ALL SELECT 'custkey', o_orderkey, CAST(o_custkey AS VARCHAR) FROM orders")
def encode_roundtrip(spark, sf_dir):
    coded = encoding.encode(orders(spark, sf_dir), ["o_orderpriority", "o_custkey"])
    name = F.when(F.col("column") == "o_custkey", "custkey").otherwise("orders")
    return encoding.decode(coded, P).select(name.alias("t"), "rid", "v")


@query("SELECT o_orderkey AS rid FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_on_codes(spark, sf_dir):
    return encoding.filter_codes(encoding.encode(orders(spark, sf_dir), ["o_orderpriority"]), "o_orderpriority", "1-URGENT", P)


@query("SELECT o_orderkey AS rid FROM orders WHERE CAST(o_custkey AS VARCHAR) = '77'")
def filter_on_codes_mixed(spark, sf_dir):
    return encoding.filter_codes(encoding.encode(orders(spark, sf_dir), ["o_custkey"]), "o_custkey", "77", P)


_WIDTH = "CASE WHEN {0} < 256 THEN 1 WHEN {0} < 65536 THEN 2 ELSE 4 END"
_VARINT = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 ELSE 4 END"


def _encoded(columns: dict[str, str]) -> str:
    """SQL: a sequential writer's pages of some columns of orders, by a recursive walk over the statistics of pages.

    ``o`` has each page's distinct values with the page before that holds the value; ``w``, for each page and each page at
    which its dictionary may have begun, how many values are new and their serialized bytes.
    """
    varint = _VARINT.format
    values = " UNION ALL ".join(f"SELECT '{name}' AS c, o_orderkey // {P} AS page, {value} AS v FROM orders" for name, value in columns.items())
    cost = f"""pages * ({_WIDTH.format("held + k")}) * {encoding.EXPECTED_ROWS} + dump + n * ({_WIDTH.format("held + k")})
      - pages * (({_WIDTH.format("d")}) * {encoding.EXPECTED_ROWS} + usual) - (ser + n * ({_WIDTH.format("d")}))"""
    return f"""WITH RECURSIVE a AS ({values}),
p AS (SELECT c, page, count(*) AS n, count(DISTINCT v) AS d FROM a GROUP BY 1, 2),
o AS (SELECT c, page, strlen(v) + {varint("strlen(v)")} AS b, coalesce(lag(page) OVER (PARTITION BY c, v ORDER BY page), -1) AS prev FROM (SELECT DISTINCT c, page, v FROM a)),
s AS (SELECT p.c, p.page, n, d, {varint("d")} + sum(b) AS ser FROM p JOIN o ON o.c = p.c AND o.page = p.page GROUP BY p.c, p.page, n, d),
l AS (SELECT x.c, x.page, y.page AS start FROM p x JOIN p y ON x.c = y.c AND y.page < x.page),
w AS (SELECT l.c, l.page, l.start, count(b) AS k, {varint("count(b)")} + coalesce(sum(b), 0) AS dump FROM l LEFT JOIN o ON o.c = l.c AND o.page = l.page AND prev < l.start GROUP BY 1, 2, 3),
r(c, page, encoding, n, epoch, base, width, added, start, held, mem, sum_added, n_added) AS (
  SELECT c, CAST(-1 AS BIGINT), 'none', CAST(0 AS BIGINT), -1, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT c FROM p)
  UNION ALL
  SELECT c, page, kind, n, CASE kind WHEN 'local' THEN epoch + 1 ELSE epoch END, CASE kind WHEN 'differential' THEN held ELSE 0 END,
    CASE kind WHEN 'plain' THEN 0 WHEN 'local' THEN {_WIDTH.format("d")} ELSE {_WIDTH.format("held + k")} END, CASE kind WHEN 'plain' THEN 0 WHEN 'local' THEN d ELSE k END,
    CASE kind WHEN 'plain' THEN NULL WHEN 'local' THEN page ELSE start END, CASE kind WHEN 'plain' THEN 0 WHEN 'local' THEN d ELSE held + k END,
    CASE kind WHEN 'plain' THEN mem WHEN 'local' THEN ser ELSE mem + dump END, CASE kind WHEN 'differential' THEN sum_added + dump ELSE 0 END, CASE kind WHEN 'differential' THEN n_added + 1 ELSE 0 END
  FROM (SELECT *, CASE WHEN d > 0.8 * n THEN 'plain' WHEN start IS NULL OR mem > {encoding.BUDGET} OR k > 0.99 * d THEN 'local'
      WHEN ((held >= 256 AND d < 256) OR (held >= 65536 AND d < 65536) OR (held < 256 AND held + k >= 256) OR (held < 65536 AND held + k >= 65536)) AND {cost} > 0 THEN 'local' ELSE 'differential' END AS kind
    FROM (SELECT r.c, s.page, s.n, r.epoch, r.start, r.held, r.mem, r.sum_added, r.n_added, s.d, CAST(s.ser AS BIGINT) AS ser, coalesce(w.k, s.d) AS k, CAST(coalesce(w.dump, s.ser) AS BIGINT) AS dump,
        CASE WHEN r.n_added > 0 THEN r.sum_added // r.n_added ELSE CAST(coalesce(w.dump, s.ser) AS BIGINT) END AS usual, ({encoding.BUDGET} - r.mem) // CAST(coalesce(w.dump, s.ser) AS BIGINT) AS pages
      FROM r JOIN s ON s.c = r.c AND s.page = r.page + 1 LEFT JOIN w ON w.c = s.c AND w.page = s.page AND w.start = r.start)))"""


@query(f"""{_encoded({"o_orderpriority": "o_orderpriority", "o_custkey": "CAST(o_custkey AS VARCHAR)", "o_totalprice": "CAST(o_totalprice AS VARCHAR)"})}
SELECT c AS name, page, encoding, CAST(n AS INTEGER) AS n, CASE WHEN encoding <> 'plain' THEN epoch END AS epoch, CAST(base AS INTEGER) AS base,
CASE WHEN encoding <> 'plain' THEN CAST(width AS INTEGER) END AS width, CAST(added AS INTEGER) AS added FROM r WHERE page >= 0""")
def encoded_pages(spark, sf_dir):
    """The page encodings of some columns."""
    rows = encoding.encode(orders(spark, sf_dir), ["o_orderpriority", "o_custkey", "o_totalprice"], run_pages=None)
    return rows.select(F.col("column").alias("name"), "page", "encoding", "n", "epoch", "base", "width", F.size("segment").alias("added"))


@query(f"""{_encoded({"o_custkey": "CAST(o_custkey AS VARCHAR)"})}
SELECT c AS name, CAST(0 AS BIGINT) AS run, epoch, page, CAST(added AS INTEGER) AS len, CAST(base AS INTEGER) AS base FROM r WHERE page >= 0 AND encoding <> 'plain'""")
def encoded_chain(spark, sf_dir):
    return encoding.chain(encoding.encode(orders(spark, sf_dir), ["o_custkey"], run_pages=None)).withColumnRenamed("column", "name")


@query(f"""SELECT CAST(q.req_pos AS BIGINT) AS req_pos, c AS name, v FROM (VALUES {_VALUES}) q(req_pos, rid)
JOIN (SELECT o_orderkey, 'o_orderpriority' AS c, o_orderpriority AS v FROM orders UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders) ON o_orderkey = q.rid""")
def lookup_on_codes(spark, sf_dir):
    coded = encoding.encode(orders(spark, sf_dir), ["o_orderpriority", "o_custkey"])
    return encoding.lookup_codes(coded, requests(spark, WANTED), P).withColumnRenamed("column", "name")


# Bloom filters


@query("""WITH k AS (SELECT unnest(range(1, 1000)) AS k), m AS (SELECT k, -k * 10000 / ln(1 - pow(0.001, 1.0 / k)) AS m FROM k)
SELECT CAST(arg_min(k, m) AS INTEGER) AS hashes, CAST(ceil(floor(min(m)) / 8) * 8 AS BIGINT) AS bits FROM m""")
def bloom_params(spark, sf_dir):
    p = bloom.optimal(10_000, 0.001)
    return spark.createDataFrame([(p.hashes, p.bits)], "hashes int, bits long")


def _bits(where: str) -> str:
    """SQL: the set bits of the customers' names, or some of them."""
    return f"SELECT DISTINCT CAST(('0x' || substr(md5(k || ':{BLOOM.seed}:' || c_name), 1, 8)) AS BIGINT) % {BLOOM.bits} AS bit FROM customer, (SELECT unnest(range({BLOOM.hashes})) AS k) WHERE {where}"


def _names(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").where(where).select("c_name")


def _filter(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return bloom.build(_names(spark, sf_dir, where), "c_name", BLOOM)


@query(_bits("true"))
def bloom_bits_md5(spark, sf_dir):
    return bloom.set_bits(_filter(spark, sf_dir, "true"))


@query("SELECT count(DISTINCT c_name) AS members, count(DISTINCT c_name) AS found FROM customer")
def bloom_no_false_negatives(spark, sf_dir):
    names = _names(spark, sf_dir, "true")
    p = bloom.optimal(1_000, 0.01)
    each = bloom.contains(names, "c_name", bloom.build(names, "c_name", p), p)
    return each.agg(F.count("*").alias("members"), F.count_if("found").alias("found"))


# Set operations and membership: the operands are the names of all customers and of all suppliers, and both filters have
# room for as many elements as there are distinct names.

_CUSTOMERS, _SUPPLIERS = "SELECT c_name AS name FROM customer", "SELECT s_name AS name FROM supplier"
_PERCENT = 5
#: The number of hashes depends on the probability alone.
_HASHES = BLOOM.hashes
_SIZED = f"""(SELECT bits, CAST(floor(bits * (1 - CAST({_PERCENT} AS DOUBLE) / 100)) AS BIGINT) // 8 * 8 AS folded FROM
(SELECT CAST(ceil(floor(-{_HASHES} * greatest(count(DISTINCT name), 1) / ln(1 - pow(0.01, 1.0 / {_HASHES}))) / 8) * 8 AS BIGINT) AS bits FROM ({_CUSTOMERS} UNION ALL {_SUPPLIERS})))"""


def _hashed(names: str) -> str:
    """SQL: each name with its bits, one for each hash, and the size that a fold leaves."""
    return f"SELECT name, k, CAST(('0x' || substr(md5(k || ':{BLOOM.seed}:' || name), 1, 8)) AS BIGINT) % bits AS bit, folded FROM ({names}), (SELECT unnest(range({_HASHES})) AS k), {_SIZED} WHERE name IS NOT NULL"


def _whole_bits(names: str) -> str:
    return f"SELECT DISTINCT bit FROM ({_hashed(names)})"


#: SQL: whether each customer's and supplier's name is found in the customers' filter.
_FOUND = f"""SELECT name AS value, bool_and(held.bit IS NOT NULL) AS found FROM ({_hashed(f"{_CUSTOMERS} UNION {_SUPPLIERS}")}) AS own
LEFT JOIN ({_whole_bits(_CUSTOMERS)}) AS held ON own.bit = held.bit GROUP BY 1"""


def _whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, bloom.Parameters]:
    """All customers' names, all suppliers' names, and the parameters of filters with room for both."""
    a = _read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    b = _read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    elements = a.union(b).agg(F.count_distinct("name")).first()[0]
    return a, b, bloom.optimal(max(elements, 1), 0.01, portable=True)


@query(f"{_whole_bits(_CUSTOMERS)} UNION {_whole_bits(_SUPPLIERS)}")
def bloom_union(spark, sf_dir):
    a, b, p = _whole(spark, sf_dir)
    return bloom.set_bits(bloom.union(bloom.build(a, "name", p), bloom.build(b, "name", p), p, p))


@query(f"{_whole_bits(_CUSTOMERS)} INTERSECT {_whole_bits(_SUPPLIERS)}")
def bloom_intersect(spark, sf_dir):
    a, b, p = _whole(spark, sf_dir)
    return bloom.set_bits(bloom.intersection(bloom.build(a, "name", p), bloom.build(b, "name", p), p, p))


@query(f"SELECT bit FROM ({_whole_bits(_CUSTOMERS)} UNION ALL {_whole_bits(_SUPPLIERS)}) GROUP BY 1 HAVING count(*) = 1")
def bloom_xor(spark, sf_dir):
    a, b, p = _whole(spark, sf_dir)
    return bloom.set_bits(bloom.difference(bloom.build(a, "name", p), bloom.build(b, "name", p), p, p))


@query(f"SELECT DISTINCT bit % folded AS bit FROM ({_hashed(_CUSTOMERS)})")
def bloom_fold(spark, sf_dir):
    a, _, p = _whole(spark, sf_dir)
    return bloom.set_bits(bloom.fold(bloom.build(a, "name", p), p, _PERCENT)[0])


@query(_FOUND)
def bloom_contains(spark, sf_dir):
    a, b, p = _whole(spark, sf_dir)
    return bloom.contains(a.union(b), "name", bloom.build(a, "name", p), p)


@query(f"""SELECT coalesce(bool_and(found), true) AS all_found, coalesce(bool_and(NOT found), true) AS none_found, min(CASE WHEN NOT found THEN value END) AS first_missing,
min(CASE WHEN found THEN value END) AS first_found FROM ({_FOUND})""")
def bloom_contains_all(spark, sf_dir):
    a, b, p = _whole(spark, sf_dir)
    return bloom.contains_all(a.union(b), "name", bloom.build(a, "name", p), p)


@query(f"""SELECT name AS value, bool_and(held.bit IS NOT NULL) AS found FROM (SELECT name, bit % folded AS bit FROM ({_hashed(f"{_CUSTOMERS} UNION {_SUPPLIERS}")})) AS own
LEFT JOIN (SELECT DISTINCT bit % folded AS bit FROM ({_hashed(_CUSTOMERS)})) AS held ON own.bit = held.bit GROUP BY 1""")
def bloom_folded_contains(spark, sf_dir):
    """Membership in a folded filter: a bit goes through the sizes that the filter had."""
    a, b, p = _whole(spark, sf_dir)
    folded, q = bloom.fold(bloom.build(a, "name", p), p, _PERCENT)
    return bloom.contains(a.union(b), "name", folded, q)


@query(f"SELECT count(*) AS bits_set, round(pow(count(*) / {BLOOM.bits}.0, {BLOOM.hashes}), 9) AS fpp FROM ({_bits('true')})")
def bloom_fpp(spark, sf_dir):
    return bloom.measured_fpp(_filter(spark, sf_dir, "true"), BLOOM).select(F.col("bits_set").cast("long").alias("bits_set"), F.round("fpp", 9).alias("fpp"))


@query("SELECT upper(w) AS word, reverse(w) AS mirrored, w || reverse(w) AS doubled FROM (SELECT DISTINCT event_type AS w FROM events)")
def word_variants(spark, sf_dir):
    words = _read(spark, sf_dir, "events").select(F.col("event_type").alias("w")).distinct()
    return words.select(F.upper("w").alias("word"), F.reverse("w").alias("mirrored"), F.concat("w", F.reverse("w")).alias("doubled"))


# Expressions of the serialized forms


@query("SELECT n, CAST(CASE WHEN n >= 0 THEN 2 * n ELSE -2 * n - 1 END AS BIGINT) AS u, n AS back FROM (SELECT o_orderkey - 700 AS n FROM orders)")
def zigzag(spark, sf_dir):
    n = _read(spark, sf_dir, "orders").select((F.col("o_orderkey") - 700).alias("n")).withColumn("u", codec.zigzag(F.col("n")))
    return n.select("n", F.col("u").cast("long").alias("u"), codec.unzigzag(F.col("u")).alias("back"))


@query("SELECT n, CAST(CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 ELSE 4 END AS INTEGER) AS bytes FROM (SELECT o_orderkey * 7 AS n FROM orders)")
def varint_bytes(spark, sf_dir):
    n = _read(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7).alias("n"))
    return n.select("n", codec.varint_length(F.col("n")).alias("bytes"))


@query("SELECT o_orderkey // 8 AS g, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 << CAST(o_orderkey % 8 AS INTEGER) ELSE 0 END) AS BIGINT) AS packed FROM orders GROUP BY 1")
def bit_pack(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey div 8").alias("g")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") == "F").alias("b")))).alias("r"))
    return rows.select("g", codec.pack_bits(F.col("r.b"))[0].cast("long").alias("packed"))


@query("""SELECT o_orderkey AS num, -o_totalprice AS second, o_orderpriority AS str, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS opt, o_custkey AS paired, o_custkey AS cell,
o_orderkey % 2 = 0 AS flag, true AS same FROM orders""")
def nested_roundtrip(spark, sf_dir):
    """Nested values of every container kind, written to bytes and read again."""
    shape = "struct<num:bigint,vec:array<double>,str:string,opt:string,pairs:map<string,bigint>,grid:array<array<bigint>>,flags:array<boolean>>"
    row = F.struct(
        F.col("o_orderkey").alias("num"), F.array("o_totalprice", -F.col("o_totalprice")).alias("vec"), F.col("o_orderpriority").alias("str"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("opt"), F.create_map("o_orderstatus", "o_custkey").alias("pairs"), F.array(F.array("o_custkey"), F.array(F.lit(0).cast("long"))).alias("grid"),
        F.array(F.col("o_orderkey") % 2 == 0).alias("flags"),
    )
    back = _read(spark, sf_dir, "orders").select("o_orderstatus", row.alias("row")).withColumn("back", typed.from_bytes(typed.to_bytes(F.col("row")), shape))
    same = F.col("back").cast("string") == F.col("row").cast("string")
    at = F.col("back")
    return back.select(at["num"].alias("num"), at["vec"][1].alias("second"), at["str"].alias("str"), at["opt"].alias("opt"), F.element_at(at["pairs"], F.col("o_orderstatus")).alias("paired"), at["grid"][0][0].alias("cell"), at["flags"][0].alias("flag"), same.alias("same"))


_HEX = "concat(" + ", ".join(f"CASE WHEN {k} < bytes THEN printf('%02X', ((n >> {7 * k}) & 127) + CASE WHEN {k} < bytes - 1 THEN 128 ELSE 0 END) ELSE '' END" for k in range(4)) + ")"


@query(f"SELECT n, {_HEX} AS encoded, n AS back FROM (SELECT n, CASE WHEN n < 128 THEN 1 WHEN n < 16384 THEN 2 WHEN n < 2097152 THEN 3 ELSE 4 END AS bytes FROM (SELECT o_orderkey * 97 AS n FROM orders))")
def varint_roundtrip(spark, sf_dir):
    n = _read(spark, sf_dir, "orders").select((F.col("o_orderkey") * 97).alias("n")).withColumn("raw", codec.varint_encode(F.col("n")))
    return n.select("n", F.hex("raw").alias("encoded"), codec.varint_decode(F.col("raw"))["value"].alias("back"))


@query(f"""SELECT page, printf('%02X', count(*)) || string_agg(printf('%02X', strlen(v)) || hex(v), '' ORDER BY v) AS encoded, string_agg(v, ',' ORDER BY v) AS back
FROM (SELECT DISTINCT event_id // {P} AS page, event_type AS v FROM events) GROUP BY 1""")
def dict_serialized(spark, sf_dir):
    """Each page's dictionary in serialized form, and read from it again."""
    rows = pages.sorted_values(events(spark, sf_dir), "event_type").select("page", codec.list_encode(F.col("values")).alias("raw"))
    return rows.select("page", F.hex("raw").alias("encoded"), F.array_join(codec.list_decode(F.col("raw")), ",").alias("back"))


@query("SELECT concat_ws('|', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority) AS line FROM orders")
def format_rows(spark, sf_dir):
    return formatted(scan(orders(spark, sf_dir), ["o_orderkey", "o_orderstatus", "o_orderpriority"]))


# Extensions: what the numbered tables are joined, sorted and grouped with


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority >= '2-HIGH' AND o_orderpriority <= '3-MEDIUM'")
def range_filter(spark, sf_dir):
    return relational.range_filter(orders(spark, sf_dir), "o_orderpriority", "2-HIGH", "3-MEDIUM", ["o_orderkey", "o_orderpriority"])


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf_dir):
    return relational.join(orders(spark, sf_dir), customers(spark, sf_dir), [("o_custkey", "c_custkey")], columns=["o_orderkey", "c_name"])


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf_dir):
    return relational.join(customers(spark, sf_dir), orders(spark, sf_dir), [("c_custkey", "o_custkey")], "left_anti", ["c_custkey", "c_name"])


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_custkey DESC, o_orderkey LIMIT 25")
def sort_top(spark, sf_dir):
    return relational.sort(orders(spark, sf_dir), ["o_orderpriority", "o_custkey"], True, 25).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_orderkey) AS first FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def group_by_cube(spark, sf_dir):
    totals = [F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.min("o_orderkey").alias("first")]
    return relational.aggregate(orders(spark, sf_dir), ["o_orderpriority", "o_orderstatus"], totals, "cube")


@query("SELECT count(*) AS n, min(o_orderpriority) AS lo, max(o_orderpriority) AS hi FROM orders")
def aggregate_all(spark, sf_dir):
    return relational.aggregate(orders(spark, sf_dir), [], [F.count("*").alias("n"), F.min("o_orderpriority").alias("lo"), F.max("o_orderpriority").alias("hi")])


_WHERE = "(o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderstatus LIKE 'F%') AND NOT o_custkey BETWEEN 10 AND 90 AND o_orderdate IS NOT NULL"


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS state FROM orders WHERE {_WHERE}")
def predicates(spark, sf_dir):
    rows = relational.where(orders(spark, sf_dir), _WHERE, ["o_orderkey", "o_orderstatus"])
    return rows.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("state"))


@query("SELECT e.event_id, e.user_id, max(p.event_id) AS purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.event_id <= e.event_id GROUP BY 1, 2")
def join_as_of(spark, sf_dir):
    rows = _read(spark, sf_dir, "events")
    bought = rows.where("event_type = 'purchase'").select("user_id", "event_id", F.col("event_id").alias("purchase"))
    return relational.as_of(rows.select("user_id", "event_id"), bought, ["user_id"], "event_id", ["purchase"]).select("event_id", "user_id", "purchase")


@query("SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_orderkey >= s_suppkey * 10 AND o_orderkey < s_suppkey * 10 + 25")
def join_interval(spark, sf_dir):
    bands = _read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 10).alias("low"), (F.col("s_suppkey") * 10 + 25).alias("high"))
    return relational.interval_join(_read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", bands, "low", "high", 32).select("o_orderkey", "s_suppkey")


@query("""SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3""")
def window_rank(spark, sf_dir):
    return relational.ranked(orders(spark, sf_dir), ["o_custkey"], [F.col("o_totalprice").desc()], 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_orderkey, count(*) OVER w AS seen, min(o_totalprice) OVER w AS least, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def window_frames(spark, sf_dir):
    keyed = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    last = keyed.rowsBetween(-2, 0)
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.count("*").over(last).alias("seen"), F.min("o_totalprice").over(last).alias("least"), F.lag("o_orderkey").over(keyed).alias("before"))


_KEYS = "SELECT c_custkey AS k FROM customer", "SELECT o_custkey AS k FROM orders"


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))


@query(f"{_KEYS[0]} UNION {_KEYS[1]}")
def set_union(spark, sf_dir):
    return relational.set_operation(*_keys(spark, sf_dir), "union")


@query(f"{_KEYS[0]} INTERSECT {_KEYS[1]}")
def set_intersect(spark, sf_dir):
    return relational.set_operation(*_keys(spark, sf_dir), "intersect")


@query(f"{_KEYS[1]} EXCEPT ALL {_KEYS[0]}")
def set_except_all(spark, sf_dir):
    return relational.set_operation(*reversed(_keys(spark, sf_dir)), "except", repeats=True)


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE CAST(('0x' || substr(md5('5:' || o_orderkey), 1, 8)) AS BIGINT) < {int(0.1 * (1 << 32))}")
def sample_rows(spark, sf_dir):
    """A tenth of the rows, by a hash of the row number: sampling is what this query is for."""
    return relational.sample(orders(spark, sf_dir), 0.1, 5).select("o_orderkey", "o_custkey")


_SUBQUERY = "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey, n FROM customer JOIN big ON c_custkey = o_custkey WHERE n > (SELECT avg(n) FROM big) AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderpriority = '1-URGENT')"


@query(_SUBQUERY)
def subqueries(spark, sf_dir):
    """SQL over the stored tables: common expressions, scalar and correlated subqueries."""
    return spark.sql(_SUBQUERY.replace("FROM orders", "FROM {orders}").replace("FROM customer", "FROM {customer}"), orders=_read(spark, sf_dir, "orders"), customer=_read(spark, sf_dir, "customer"))


@query("SELECT o_orderkey, length(o_orderpriority) * 2 + o_orderkey % 7 AS score FROM orders")
def user_function(spark, sf_dir):
    """A function of one's own, over Arrow batches."""

    @F.pandas_udf("long")
    def score(text: pd.Series, n: pd.Series) -> pd.Series:
        return text.str.len() * 2 + n % 7

    return _read(spark, sf_dir, "orders").select("o_orderkey", score("o_orderpriority", "o_orderkey").alias("score"))
