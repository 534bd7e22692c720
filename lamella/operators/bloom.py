"""Bloom filters as tables of bits.

A filter is a frame (word, bits) of 32-bit words with ``Parameters`` beside it. Building one sets bits with a partial
``bit_or`` for each word. Values are tested in place against a filter of at most ``IN_PLACE_BITS``, which every task gets
as one array of words; against a larger one, by a join of a value's bits with the words, which scales with the filter.
Filters of equal parameters combine word by word. Hashes come from xxhash64, or from md5 where other systems are to
reproduce them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 32
#: Bits, by a filter's parameters, up to which it is sent to every task: 2 MB as an array of words; and hashes, as a plan
#: has an expression for each.
IN_PLACE_BITS, IN_PLACE_HASHES = 1 << 23, 32


@dataclass(frozen=True)
class Parameters:
    """``hashes`` bits for each element among ``bits``; ``sizes`` are the larger sizes from which the filter was folded."""

    hashes: int
    bits: int
    seed: int = 0xA5A5A5A5
    portable: bool = False
    sizes: tuple[int, ...] = ()


def optimal(elements: int, fpp: float, most_hashes: int = 999, least_bits: int = 1, most_bits: int | None = None, seed: int = 0xA5A5A5A5, portable: bool = False) -> Parameters:
    """The number of hashes, up to a limit, that needs the fewest bits, which are then rounded up to whole bytes."""
    if elements < 1 or not 0 < fpp < 1 or seed in (0, (1 << 64) - 1):
        raise ValueError("a filter needs elements, a probability between 0 and 1 and a seed")
    bits, hashes = min((-k * elements / math.log(1 - fpp ** (1 / k)), k) for k in range(1, most_hashes + 1))
    whole = -(-int(bits) // 8) * 8
    return Parameters(hashes, max(least_bits, min(whole, most_bits or whole)), seed, portable)


def _position(value: Column, k: Column, p: Parameters) -> Column:
    """The bit of a value's hash ``k``, through the sizes of folded filters in turn."""
    salt = F.concat_ws(":", k.cast("string"), F.lit(str(p.seed)), value.cast("string"))
    h = F.conv(F.substring(F.md5(salt), 1, 8), 16, 10).cast("long") if p.portable else F.xxhash64(k, F.lit(p.seed), value.cast("string"))
    for size in (*p.sizes, p.bits):
        h = F.pmod(h, F.lit(size))
    return h


def positions(value: Column, p: Parameters) -> Column:
    """The bits of a value: one for each hash."""
    return F.transform(F.sequence(F.lit(0), F.lit(p.hashes - 1)), lambda k: _position(value, k, p))


def _words(bit: Column) -> tuple[Column, Column]:
    return F.floor(bit / WORD).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % WORD).cast("int")).alias("bits")


def build(values: DataFrame, column: str, p: Parameters) -> DataFrame:
    """(word, bits) with the bits of every value; nulls are left out."""
    bit = values.where(F.col(column).isNotNull()).select(F.explode(positions(F.col(column), p)).alias("bit"))
    return bit.select(*_words(F.col("bit"))).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _dense(filter_: DataFrame) -> DataFrame:
    """One row with one array: the bits of every word up to the last one that has any."""
    held = filter_.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))

    def gap(w: Column, k: Column) -> Column:
        before = F.coalesce(F.get("w", k - 1)["word"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(0).cast("long"), (w["word"] - before - 1).cast("int")), F.array(w["bits"]))

    return held.select(F.flatten(F.transform("w", gap)).alias("words"))


def contains(values: DataFrame, column: str, filter_: DataFrame, p: Parameters) -> DataFrame:
    """Each distinct value with ``found``: whether all its bits are set. Values that were inserted always are."""
    own = values.select(F.col(column).alias("value")).where("value is not null").distinct()
    if p.bits <= IN_PLACE_BITS and p.hashes <= IN_PLACE_HASHES:
        words, found = _dense(filter_).scalar(), F.lit(True)
        for k in range(p.hashes):
            word, mask = _words(_position(F.col("value"), F.lit(k), p))
            found &= F.coalesce(F.get(words, word.cast("int")), F.lit(0)).bitwiseAND(mask) != 0
        return own.select("value", found.alias("found"))
    bit = own.select("value", F.explode(positions(F.col("value"), p)).alias("bit"))
    probe = bit.select("value", *(c.alias(n) for c, n in zip(_words(F.col("bit")), ("word", "mask"), strict=True)))
    held = probe.join(filter_, "word", "left").withColumn("set", F.coalesce(F.col("bits"), F.lit(0)).bitwiseAND(F.col("mask")) != 0)
    return held.groupBy("value").agg(F.bool_and("set").alias("found"))


def contains_all(values: DataFrame, column: str, filter_: DataFrame, p: Parameters) -> DataFrame:
    """(all_found, none_found, first_missing, first_found) over all values; the first ones by value."""
    each = contains(values, column, filter_, p)
    return each.agg(
        F.coalesce(F.bool_and("found"), F.lit(True)).alias("all_found"), F.coalesce(F.bool_and(~F.col("found")), F.lit(True)).alias("none_found"),
        F.min(F.when(~F.col("found"), F.col("value"))).alias("first_missing"), F.min(F.when(F.col("found"), F.col("value"))).alias("first_found"),
    )


def _same(a: Parameters, b: Parameters) -> None:
    if a != b:
        raise ValueError("only filters of equal parameters combine")


def union(a: DataFrame, b: DataFrame, pa: Parameters, pb: Parameters) -> DataFrame:
    _same(pa, pb)
    return a.union(b).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def intersection(a: DataFrame, b: DataFrame, pa: Parameters, pb: Parameters) -> DataFrame:
    _same(pa, pb)
    both = a.join(b.withColumnRenamed("bits", "other"), "word").select("word", F.col("bits").bitwiseAND(F.col("other")).alias("bits"))
    return both.where("bits != 0")


def difference(a: DataFrame, b: DataFrame, pa: Parameters, pb: Parameters) -> DataFrame:
    """Bits that one of the two filters has."""
    _same(pa, pb)
    return a.union(b).groupBy("word").agg(F.bit_xor("bits").alias("bits")).where("bits != 0")


def set_bits(filter_: DataFrame) -> DataFrame:
    """(bit): every bit that is set."""
    each = filter_.select("word", "bits", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("k"))
    return each.where(F.expr("bit_get(bits, k) = 1")).select((F.col("word") * WORD + F.col("k")).alias("bit"))


def fold(filter_: DataFrame, p: Parameters, percent: float) -> tuple[DataFrame, Parameters]:
    """The filter shrunk by a share of its bits: each bit moves to its place modulo the new size."""
    bits = int(p.bits * (1 - percent / 100)) // 8 * 8
    if not 0 <= percent < 100 or not 0 < bits < p.bits:
        raise ValueError("a fold has to leave fewer bits, and some")
    moved = set_bits(filter_).select(F.pmod("bit", F.lit(bits)).alias("bit")).select(*_words(F.col("bit")))
    return moved.groupBy("word").agg(F.bit_or("bits").alias("bits")), replace(p, bits=bits, sizes=(*p.sizes, p.bits))


def expected_fpp(p: Parameters, inserted: int) -> float:
    """The share of other values that will be taken for members, from the number of insertions."""
    return (1 - math.exp(-p.hashes * inserted / p.bits)) ** p.hashes


def measured_fpp(filter_: DataFrame, p: Parameters) -> DataFrame:
    """(bits_set, fpp): the same from the bits that are set, which holds after set operations too."""
    count = F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))
    return filter_.agg(count.alias("bits_set"), F.pow(count / p.bits, F.lit(p.hashes)).alias("fpp"))


def describe(filter_: DataFrame, p: Parameters, inserted: int) -> DataFrame:
    """(bits, hashes, seed, folds, bits_set, is_empty, expected_fpp) of a filter."""
    count = F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long")
    known = {"bits": p.bits, "hashes": p.hashes, "seed": p.seed, "folds": len(p.sizes)}
    return filter_.agg(*(F.lit(v).cast("long").alias(k) for k, v in known.items()), count.alias("bits_set"), (count == 0).alias("is_empty"), F.lit(expected_fpp(p, inserted)).alias("expected_fpp"))


def same(a: DataFrame, b: DataFrame, pa: Parameters, pb: Parameters) -> bool:
    """Whether two filters have equal parameters and bits."""
    return pa == pb and not a.union(b).groupBy("word").agg(F.bit_xor("bits").alias("bits")).where("bits != 0").limit(1).count()
