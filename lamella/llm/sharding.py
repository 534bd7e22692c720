"""Sharding by balanced label propagation, in Spark's own functions.

Documents are linked where their texts are equal. Every document starts at a shard by its hash; those of a group that start
together, and fall into the same one of ``pieces`` by hash, are a cell, which moves as one. A group's cells so spread over
many tasks, however large it is. In each round a join tells every cell which shard holds most of its group, and cells ask to
move there. Two shards exchange the documents that they ask of each other; beyond that, a shard grants requests, whole groups
in the order of a hash, as long as their exact running sum stays within the room that its quota leaves beside the linked
documents it holds. A group too large for one shard is given as many of its fullest shards as it needs, and its cells ask for one of these each.

The law kept is ``rows``: counts at most one apart, quotas of ``total / shards``. Documents without links stay where their
hash puts them, behind the linked ones of a shard. What is beyond a shard's quota then, first those without links, fills the
shards that have room, in order: only a surplus ever leaves the shard that its label names. Running sums are taken by
hierarchy (shard and part, cell, row), so that no shard is gathered in one task.

Edge cases: a null text has no bytes and equals an empty one; repeated rows and null doc_ids take a row each; with fewer
documents than shards some stay empty; a table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import stored

SHARDS, ROUNDS = 40, 6
#: Least number of pieces of a group's documents at one shard, documents of a cell that pieces are meant for, and parts of a
#: shard, for running sums.
PIECES, CELL, PARTS = 16, 100_000, 256
#: Share of a quota that a group may hope to find free; a larger group asks for several shards.
ROOM = 0.5


def _hashed(salt: int, *columns: str) -> Column:
    return F.xxhash64(*columns, F.lit(salt))


def _dealt(n: int, salt: int, *columns: str) -> Column:
    return F.pmod(_hashed(salt, *columns), F.lit(n)).cast("int")


def _before(rows: DataFrame, key: str, part: Column, order: list[str]) -> DataFrame:
    """``rows`` with ``before``: the sum of n over the rows of the same key that come before, by part and ``order``.

    The sums of the parts are few, keys x PARTS at most, and are added up in one task; within a part they are added up where
    the part is.
    """
    parted = rows.withColumn("part", part)
    sums = parted.groupBy(key, "part").agg(F.sum("n").alias("part_n"))
    ahead = sums.select(key, "part", (F.sum("part_n").over(Window.partitionBy(key).orderBy("part")) - F.col("part_n")).alias("ahead"))
    within = F.sum("n").over(Window.partitionBy(key, "part").orderBy(*order)) - F.col("n")
    return parted.withColumn("within", within).join(F.broadcast(ahead), [key, "part"]).withColumn("before", F.col("ahead") + F.col("within")).drop("part", "within", "ahead")


def _proposed(cells: DataFrame, quota: int) -> DataFrame:
    """Each cell with ``to``: the shard that holds most of its group, or, of as many as a large group needs, one by its hash.

    Ties go by a hash, as these would else all go one way. A group is at ``SHARDS`` shards at most.
    """
    held = cells.groupBy("g", "shard").agg(F.sum("n").alias("n"))
    ranked = F.reverse(F.array_sort(F.collect_list(F.struct("n", _hashed(5, "g", "shard").alias("lot"), "shard"))))
    best = held.groupBy("g").agg(F.transform(ranked, lambda x: x["shard"]).alias("best"), F.sum("n").alias("group_n"))
    needed = best.select("g", F.slice("best", F.lit(1), F.ceil(F.col("group_n") / (ROOM * quota)).cast("int")).alias("best"))
    own = F.get("best", F.pmod(_hashed(6, "g", "start", "piece"), F.size("best").cast("long")).cast("int"))
    return cells.join(needed, "g").withColumn("to", F.when(F.array_contains("best", F.col("shard")), F.col("shard")).otherwise(own)).drop("best")


def propagate(cells: DataFrame, total: int, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """Cells (g, start, piece, n) with the shards at which they end; ``total`` counts all documents, linked or not.

    Two shards first exchange what they ask of each other, as many documents either way; then shards take cells up to their
    quota, total div shards. An exchange is even but for less than a cell, and what it leaves is counted before room is given.
    """
    quota = total // shards
    now = stored(cells.withColumn("shard", F.col("start")), "cells")
    for k in range(rounds):
        lot = _dealt(PARTS, 10 + k, "g")
        order = ["g", "start", "piece"]
        asks = _proposed(now, max(1, quota)).where("to != shard").withColumn("pair", F.col("shard") * shards + F.col("to"))
        asked = asks.groupBy("shard", "to").agg(F.sum("n").alias("n"))  # a row for each two shards at most
        both = asked.alias("x").join(F.broadcast(asked.alias("y")), F.expr("x.shard = y.to and x.to = y.shard")).select((F.col("x.shard") * shards + F.col("x.to")).alias("pair"), F.least("x.n", "y.n").alias("both"))
        counted = stored(_before(asks, "pair", lot, order).join(F.broadcast(both), "pair", "left").select(*order, "n", "shard", "to", (F.col("before") + F.col("n") <= F.coalesce("both", F.lit(0))).alias("swaps")), "asks")
        flow = counted.where("swaps").select(F.explode(F.array(F.struct("shard", (-F.col("n")).alias("n")), F.struct(F.col("to").alias("shard"), "n"))).alias("f")).select("f.*")
        load = now.select("shard", "n").union(flow).groupBy(F.col("shard").alias("to")).agg(F.sum("n").alias("load"))
        fits = _before(counted.where("not swaps"), "to", lot, order).join(F.broadcast(load), "to", "left").where(F.col("before") + F.col("n") + F.coalesce("load", F.lit(0)) <= quota)
        moves = stored(counted.where("swaps").select(*order, F.col("to").alias("moved")).union(fits.select(*order, F.col("to").alias("moved"))), "moves")
        if not moves.limit(1).count():
            break
        now = stored(now.join(moves, order, "left").select(*order, "n", F.coalesce("moved", "shard").alias("shard")), "cells")
    return now


def labelled(docs: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, DataFrame, int]:
    """The documents as rows (doc_id, size, text_crc32, g, rid, start, piece, in_cell), their cells with ``linked`` and, after
    propagation, ``shard``, and their number."""
    slim = common.narrow(docs, "doc_id", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = slim.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"))
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")  # so that a row keeps its rid
    total = rows.count()
    pieces = max(PIECES, total // (shards * CELL))
    rows = rows.withColumns({"start": _dealt(shards, 1, "rid"), "piece": _dealt(pieces, 3, "rid")})
    in_cell = Window.partitionBy("g", "start", "piece").orderBy("rid")
    rows = stored(rows.withColumn("in_cell", F.row_number().over(in_cell).cast("long") - 1), "rows")
    cells = rows.groupBy("g", "start", "piece").agg(F.count("*").alias("n"))
    sums = cells.groupBy("g").agg(F.sum("n").alias("group_n"))
    cells = stored(cells.join(sums, "g").select("g", "start", "piece", "n", (F.col("group_n") > 1).alias("linked")), "cells")
    moved = propagate(cells.where("linked").drop("linked"), total, shards)
    lone = cells.where("not linked").select("g", "start", "piece", "n", F.col("start").alias("shard"))
    return rows, moved.withColumn("linked", F.lit(True)).unionByName(lone.withColumn("linked", F.lit(False))), total


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot of each document."""
    with common.scope() as keep:
        rows, cells, total = labelled(docs, shards)
        # Linked documents come first in a shard, a group's together.
        part = F.when(F.col("linked"), 0).otherwise(PARTS) + _dealt(PARTS, 4, "g")
        placed = keep(stored(_before(cells, "shard", part, ["g", "start", "piece"]).select("g", "start", "piece", F.col("shard").alias("label"), "before"), "placed"))
        held = {r[0]: r[1] for r in cells.groupBy("shard").agg(F.sum("n")).collect()}  # a number for each shard
        keep(rows)
    quota = [(s + 1) * total // shards - s * total // shards for s in range(shards)]
    load = [held.get(s, 0) for s in range(shards)]
    over, free = ([max(0, a - b) for a, b in zip(*pair, strict=True)] for pair in ((load, quota), (quota, load)))
    ahead = lambda own: F.array(*(F.lit(sum(own[:s])).cast("long") for s in range(shards)))
    number = lambda own, k: F.array(*(F.lit(x).cast("long") for x in own))[k]
    rank = F.col("before") + F.col("in_cell")
    named = rows.join(placed, ["g", "start", "piece"]).select("doc_id", "size", "text_crc32", "label", rank.alias("rank"))
    surplus = F.col("rank") - number(quota, F.col("label"))
    named = named.withColumn("u", F.when(surplus >= 0, ahead(over)[F.col("label")] + surplus))
    # The shard with room whose stretch of the surplus holds u: the last that begins at or before it.
    to = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: (number(free, s) > 0) & (ahead(free)[s] <= F.col("u"))))
    named = named.withColumn("shard", F.when(F.col("u").isNull(), F.col("label")).otherwise(to).cast("int"))
    slot = F.when(F.col("u").isNull(), F.col("rank")).otherwise(number(load, F.col("shard")) + F.col("u") - ahead(free)[F.col("shard")])
    return named.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents"))
