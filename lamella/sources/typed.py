"""Typed values to bytes, text and files, and back: every scalar, array, set, map, pair, struct and optional value."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def to_text(value: Column) -> Column:
    """A struct, map or array as JSON, absent values included."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def from_text(text: Column, shape: str) -> Column:
    return F.from_json(text, shape)


def to_bytes(value: Column) -> Column:
    return F.encode(to_text(value), "UTF-8")


def from_bytes(raw: Column, shape: str) -> Column:
    return from_text(F.decode(raw, "UTF-8"), shape)


def as_set(values: Column) -> Column:
    """An array's values, once each, in order."""
    return F.array_sort(F.array_distinct(values))


class Custom(NamedTuple):
    """A type of one's own: how a value becomes a struct of known types, and again a value; both are expressions."""

    pack: Callable[[Column], Column]
    shape: str
    unpack: Callable[[Column], Column]

    def to_bytes(self, value: Column) -> Column:
        return to_bytes(self.pack(value))

    def from_bytes(self, raw: Column) -> Column:
        return self.unpack(from_bytes(raw, self.shape))


def as_map(pairs: Column) -> Column:
    """A map of an array of (key, value) structs of any types; of repeated keys the last one counts."""
    indexed = F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), (-i).alias("at"), p["value"].alias("value")))
    # Sorted by key and place, the last of a key comes first, and a pair stays if the one before has another key.
    ordered = F.array_sort(indexed)
    kept = F.transform(F.array(ordered), lambda z: F.filter(z, lambda p, i: F.coalesce(F.get(z, i - 1)["key"] != p["key"], F.lit(True))))[0]
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"))))


def write(rows: DataFrame, folder: str, form: str = "parquet", compression: str = "snappy") -> None:
    """A typed table as Parquet or ORC."""
    rows.write.mode("overwrite").option("compression", compression).format(form).save(folder)


def read(spark: SparkSession, folder: str, schema: StructType | None = None, form: str = "parquet") -> DataFrame:
    reader = spark.read.format(form)
    return (reader.schema(schema) if schema else reader).load(folder)


def write_lines(rows: DataFrame, folder: str) -> None:
    """A table of one text column as text files."""
    rows.write.mode("overwrite").text(folder)
