"""Expressions for the integer and size encodings: zigzag, base-128 lengths, code widths and bit packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(n: Column) -> Column:
    """Signed to unsigned, small magnitudes first: 0, -1, 1, -2 -> 0, 1, 2, 3 (as a decimal, so that no long overflows)."""
    wide = n.cast("decimal(20,0)")
    return F.when(n >= 0, wide * 2).otherwise(wide * -2 - 1)


def unzigzag(u: Column) -> Column:
    wide = u.cast("decimal(20,0)")
    half = F.floor(wide / 2)
    return F.when(wide % 2 == 0, half).otherwise(-half - 1).cast("long")


def varint_length(n: Column) -> Column:
    """Bytes of an unsigned integer in base 128."""
    out = F.when(n < 1 << 7, 1)
    for k in range(2, 9):
        out = out.when(n < 1 << 7 * k, k)
    return out.otherwise(F.when(n.cast("decimal(20,0)") < F.lit(str(1 << 63)).cast("decimal(20,0)"), 9).otherwise(10))


def varint_encode(n: Column) -> Column:
    """An unsigned integer under 2 ** 63 in base 128, the lowest digit first; all bytes but the last have their highest bit set."""
    length = varint_length(n)
    one = lambda k: F.shiftright(n.cast("long"), 7 * k).bitwiseAND(F.lit(127).cast("long")) + F.when(F.lit(k) < length - 1, 128).otherwise(0)
    return F.unhex(F.concat(*(F.when(F.lit(k) < length, F.lpad(F.hex(one(k)), 2, "0")).otherwise("") for k in range(9))))


def _byte(raw: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(raw, at + 1, F.lit(1))), 16, 10).cast("long")


def varint_decode(raw: Column, at: Column | int = 0) -> Column:
    """struct(value, next): the integer whose bytes begin at ``at``, and where the next value begins."""
    start = F.lit(at) if isinstance(at, int) else at
    first = F.struct(F.lit(0).cast("long").alias("value"), start.cast("int").alias("next"), F.lit(True).alias("open"))

    def step(s: Column, k: Column) -> Column:
        b = _byte(raw, start + k)
        more = F.struct((s["value"] + F.call_function("shiftleft", b.bitwiseAND(F.lit(127).cast("long")), k * 7)).alias("value"), (s["next"] + 1).alias("next"), (b >= 128).alias("open"))
        return F.when(s["open"], more).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.lit(8)), first, step, lambda s: F.struct(s["value"].alias("value"), s["next"].alias("next")))


def text_encode(text: Column) -> Column:
    """A text in serialized form: the length of its bytes, and them."""
    raw = F.encode(text, "UTF-8")
    return F.concat(varint_encode(F.octet_length(text).cast("long")), raw)


def list_encode(values: Column) -> Column:
    """An array of texts in serialized form: its size, and each text."""
    hexed = F.array_join(F.transform(values, lambda v: F.hex(text_encode(v))), "")
    return F.concat(varint_encode(F.size(values).cast("long")), F.unhex(hexed))


def list_decode(raw: Column) -> Column:
    """The array of texts again; meant for short lists, as an array grows by being copied."""
    count = varint_decode(raw)
    start = F.struct(count["next"].alias("at"), F.array().cast("array<string>").alias("l"))

    def step(s: Column, _: Column) -> Column:
        size = varint_decode(raw, s["at"])
        end = (size["next"] + size["value"].cast("int")).alias("at")
        return F.struct(end, F.concat(s["l"], F.array(F.decode(F.substring(raw, size["next"] + 1, size["value"].cast("int")), "UTF-8"))).alias("l"))

    return F.when(count["value"] == 0, F.array().cast("array<string>")).otherwise(F.aggregate(F.sequence(F.lit(1), count["value"].cast("int")), start, step, lambda s: s["l"]))


def text_bytes(text: Column) -> Column:
    """Serialized size of a text: the length of its length, and its bytes."""
    size = F.octet_length(text).cast("long")
    return varint_length(size) + size


def list_bytes(values: Column) -> Column:
    """Serialized size of an array of texts."""
    return varint_length(F.size(values).cast("long")) + F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + text_bytes(x))


def code_width(entries: Column) -> Column:
    """Bytes for a code into a dictionary of so many entries."""
    return F.when(entries < 256, 1).when(entries < 65_536, 2).otherwise(4)


def pack_bits(bits: Column) -> Column:
    """An array of booleans as bytes of eight, the first in the lowest bit."""
    count = F.ceil(F.size(bits) / 8).cast("int")
    at = lambda i, k: F.coalesce(F.get(bits, i * 8 + k), F.lit(False)).cast("int") * (1 << k)
    return F.when(F.size(bits) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: sum((at(i, k) for k in range(1, 8)), at(i, 0))))


def unpack_bits(packed: Column, n: Column) -> Column:
    bit = lambda i: F.pmod(F.floor(F.get(packed, F.floor(i / 8).cast("int")) / F.pow(F.lit(2), i % 8)), F.lit(2)) == 1
    return F.when(n == 0, F.array().cast("array<boolean>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), bit))


def to_int(text: Column) -> Column:
    """The integer with which a text begins, after white space; 0 if there is none."""
    digits = F.regexp_extract(text, r"^\s*([+-]?[0-9]{1,18})", 1)
    return F.when(digits == "", F.lit(0)).otherwise(digits).cast("long")


def truncated_mean(values: Column) -> Column:
    """The mean of an array of integers, without its fraction; 0 for none."""
    total = F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(F.size(values) == 0, F.lit(0)).otherwise((total / F.size(values)).cast("long"))
