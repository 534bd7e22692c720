"""Adaptive page encoding of text columns: plain, local dictionary or differential dictionary.

One row of the encoded form is one column of one page. A page's encoding depends on the pages before it in its *run*, as a
dictionary is kept from page to page until it is dropped, so a run's pages are walked in order, as a stream: a task holds
one page and the current dictionary, whose size has a budget. Runs of ``run_pages`` pages start afresh, as separate files
would, and are encoded in parallel; within one run the decisions are those of a single sequential writer. Without ``run_pages`` a column is one run: its encodings
equal such a writer's at any size, and one task walks all its pages.

Rules for a page, in this order: over 80 % distinct values: plain, and the dictionary is dropped. No dictionary, or one
over its budget of bytes: local. Over 99 % of its distinct values new: local. A code width would grow, or the page's own
would be narrower, and the break-even says that starting afresh pays: local. Else differential: new values are appended.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pages import NEW_RATIO, PLAIN_RATIO
from .table import Table

#: Fixed values of the format: bytes that a dictionary may take, and rows that the break-even expects of coming pages.
BUDGET, EXPECTED_ROWS = 16_384_000, 65_535
PLAIN, LOCAL, DIFFERENTIAL = "plain", "local", "differential"
#: Pages that are encoded one after the other.
RUN_PAGES = 1_024

SCHEMA = (
    "run long, page long, column string, encoding string, n int, epoch int, base int, width int, segment array<string>, codes array<int>, vals array<string>, "
    "min_v string, max_v string, min_new string, max_new string"
)


def varint(n: int) -> int:
    return max(1, -(-n.bit_length() // 7))


def serialized(values: Sequence[str]) -> int:
    """Bytes of a list of texts in the serialized form."""
    sizes = [len(v.encode("utf-8", "surrogatepass")) for v in values]
    return varint(len(values)) + sum(varint(s) + s for s in sizes)


def width(entries: int) -> int:
    return 1 if entries < 256 else 2 if entries < 65_536 else 4


@dataclass
class Writer:
    """The state of one column between pages."""

    codes: dict[str, int] = field(default_factory=dict)
    memory: int = 0
    added: list[int] = field(default_factory=list)
    epoch: int = -1

    def choose(self, n: int, distinct: list[str], new: list[str]) -> str:
        """The encoding of a page of ``n`` values, from its sorted distinct ones and those that the dictionary lacks."""
        if len(distinct) > PLAIN_RATIO * n:
            return PLAIN
        if not self.codes or self.memory > BUDGET or len(new) > NEW_RATIO * len(distinct):
            return LOCAL
        held, grown, own = len(self.codes), len(self.codes) + len(new), len(distinct)
        crosses = (held >= 256 > own) or (held >= 65_536 > own) or (held < 256 <= grown) or (held < 65_536 <= grown)
        return LOCAL if crosses and self.gain(n, distinct, new) > 0 else DIFFERENTIAL

    def gain(self, n: int, distinct: list[str], new: list[str]) -> int:
        """Bytes that a fresh dictionary saves over as many coming pages as the budget has room for."""
        local, differential = width(len(distinct)), width(len(self.codes) + len(new))
        dump = serialized(new)
        usual = sum(self.added) // len(self.added) if self.added else dump
        pages = (BUDGET - self.memory) // dump
        keep = pages * differential * EXPECTED_ROWS + dump + n * differential
        return keep - pages * (local * EXPECTED_ROWS + usual) - (serialized(distinct) + n * local)

    def page(self, values: pa.StringArray) -> dict:
        """The page's row but for its names, with Arrow arrays for lists; the state moves on. Only the distinct values of
        pages with a dictionary become Python objects."""
        coded = values.dictionary_encode()
        n, found = len(values), coded.dictionary
        if len(found) > PLAIN_RATIO * n:
            self.codes, self.added = {}, []
            bounds = pc.min_max(found)
            row = {"encoding": PLAIN, "n": n, "min_v": bounds["min"].as_py(), "max_v": bounds["max"].as_py(), "codes": None, "vals": values}
            return row | {"segment": found[:0], "base": 0, "epoch": None, "width": None, "min_new": " ", "max_new": " "}
        order = pc.array_sort_indices(found)
        ordered = found.take(order)
        distinct = ordered.to_pylist()
        held = np.fromiter((self.codes.get(v, -1) for v in distinct), dtype=np.int32, count=len(distinct))
        new = [v for v, code in zip(distinct, held.tolist(), strict=True) if code < 0]
        kind = self.choose(n, distinct, new)
        if kind == LOCAL:
            self.codes, self.memory, self.added, new = {}, 0, [], distinct
            self.epoch += 1
            held[:] = -1
        base = len(self.codes)
        fresh = held < 0
        held[fresh] = np.arange(base, base + len(new), dtype=np.int32)
        self.codes |= zip(new, range(base, base + len(new)), strict=True)
        size = serialized(new)
        self.memory += size
        if kind == DIFFERENTIAL:
            self.added.append(size)
        code = np.empty(len(distinct), dtype=np.int32)
        code[order.to_numpy()] = held
        return {
            "encoding": kind, "n": n, "min_v": distinct[0], "max_v": distinct[-1], "codes": pa.array(code[coded.indices.to_numpy()]), "vals": None,
            "segment": ordered.filter(pa.array(fresh)), "base": base, "epoch": self.epoch, "width": width(len(self.codes)),
            "min_new": new[0] if new else " ", "max_new": new[-1] if new else " ",
        }

    def encode(self, values: list[str]) -> dict:
        """The same of Python texts, with lists."""
        return {k: v.to_pylist() if isinstance(v, pa.Array) else v for k, v in self.page(pa.array(values, pa.string())).items()}


_TYPES = pa.schema(
    [("run", pa.int64()), ("page", pa.int64()), ("column", pa.string()), ("encoding", pa.string()), ("n", pa.int32()), ("epoch", pa.int32()), ("base", pa.int32()), ("width", pa.int32())]
    + [("segment", pa.list_(pa.string())), ("codes", pa.list_(pa.int32())), ("vals", pa.list_(pa.string()))]
    + [(c, pa.string()) for c in ("min_v", "max_v", "min_new", "max_new")]
)


def _cell(value: object, kind: pa.DataType) -> pa.Array:
    """An array of one value, which for lists is an array itself."""
    if isinstance(value, pa.Array):
        return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value)
    return pa.array([value], kind)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.StringArray]]:
    """((column, run, page), values) of rows that come in the order of pages; what is held is one page and one batch."""
    key, held = None, []
    for batch in batches:
        at = [c.to_numpy() for c in batch.columns[:3]]
        edges = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in at]), [True]))) if len(batch) else []
        for begin, end in itertools.pairwise(edges):
            own = tuple(int(c[begin]) for c in at)
            if held and own != key:
                yield key, pa.concat_arrays(held)
                held = []
            key = own
            held.append(batch.column(3).slice(begin, end - begin))
    if held:
        yield key, pa.concat_arrays(held)


def _walk(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, at = Writer(), None
        for (column, run, page), values in _pages(batches):
            if (column, run) != at:
                writer, at = Writer(), (column, run)
            row = {"run": run, "page": page, "column": names[column]} | writer.page(values)
            yield pa.RecordBatch.from_arrays([_cell(row[f.name], f.type) for f in _TYPES], schema=_TYPES)

    return run


def encode(table: Table, columns: Sequence[str] | None = None, run_pages: int | None = RUN_PAGES) -> DataFrame:
    """The encoded pages of the chosen columns; without ``run_pages`` a column is one run, as of a single writer."""
    names = list(dict.fromkeys(table.names(columns)))
    run = F.expr(f"page div {run_pages}") if run_pages else F.lit(0).cast("long")
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.coalesce(F.col(name).cast("string"), F.lit("")).alias("v")) for k, name in enumerate(names)))).alias("p")
    rows = table.df.select(table.page().alias("page"), table.slot().alias("slot"), values).select("p.c", run.alias("run"), "page", "p.v", "slot")
    return rows.repartition("c", "run").sortWithinPartitions("c", "run", "page", "slot").drop("slot").mapInArrow(_walk(names), SCHEMA)


def dictionary(encoded: DataFrame) -> DataFrame:
    """(column, run, epoch, code, v): what the codes of an epoch stand for, across the segments of its chain."""
    entries = encoded.where("encoding != 'plain'").select("column", "run", "epoch", "base", F.posexplode("segment").alias("k", "v"))
    return entries.select("column", "run", "epoch", (F.col("base") + F.col("k")).alias("code"), "v")


def decode(encoded: DataFrame, page_size: int) -> DataFrame:
    """(column, rid, v): the values again."""
    rid = (F.col("page") * page_size + F.col("slot")).alias("rid")
    plain = encoded.where("encoding = 'plain'").select("column", "page", F.posexplode("vals").alias("slot", "v")).select("column", rid, "v")
    coded = encoded.where("encoding != 'plain'").select("column", "run", "epoch", "page", F.posexplode("codes").alias("slot", "code"))
    return coded.join(dictionary(encoded), ["column", "run", "epoch", "code"]).select("column", rid, "v").union(plain)


def filter_codes(encoded: DataFrame, column: str, value: str, page_size: int) -> DataFrame:
    """(rid) of the rows whose column equals a text, found on codes: the text becomes one code for each epoch, pages whose
    bounds exclude it are skipped, a page that holds nothing else matches as a whole, and only plain pages compare texts."""
    own = encoded.where((F.col("column") == column) & (F.col("min_v") <= value) & (F.col("max_v") >= value))
    wanted = dictionary(encoded.where(F.col("column") == column)).where(F.col("v") == value).select("run", "epoch", F.col("code").alias("wanted"))
    slots, at = F.expr("sequence(0, n - 1)"), F.col("wanted")
    coded, plain = F.filter(slots, lambda k: F.get("codes", k) == at), F.filter(slots, lambda k: F.get("vals", k) == value)
    hits = F.when(F.col("min_v") == F.col("max_v"), slots).when(F.col("encoding") == PLAIN, plain).otherwise(coded)
    # Plain pages have no epoch; a key of their own each spreads them over the join's tasks.
    keyed = own.withColumn("epoch", F.coalesce(F.col("epoch").cast("long"), -1 - F.col("page")))
    pages = keyed.join(wanted, ["run", "epoch"], "left").where("wanted is not null or encoding = 'plain'")
    return pages.select("page", F.explode(hits).alias("slot")).select((F.col("page") * page_size + F.col("slot")).alias("rid"))


def lookup_codes(encoded: DataFrame, asked: DataFrame, page_size: int) -> DataFrame:
    """(req_pos, column, v) of the rows (req_pos, rid) asked for, gathered from their slots: a page is joined only if one of
    its rows is asked for, and only codes that are asked for are looked up in the dictionary."""
    placed = asked.where("rid >= 0").select("req_pos", F.expr(f"rid div {page_size}").alias("page"), F.expr(f"cast(rid % {page_size} as int)").alias("slot"))
    pages = encoded.join(placed.select("page").distinct(), "page", "left_semi").select("column", "run", "epoch", "page", "n", "encoding", "codes", "vals")
    # A page's rows are asked for together, so that the page travels once.
    slots = placed.groupBy("page").agg(F.collect_list(F.struct("req_pos", "slot")).alias("slots"))
    found = pages.join(slots, "page").select("column", "run", "epoch", F.explode(F.filter(F.transform("slots", lambda s: F.struct(s["req_pos"].alias("req_pos"), (s["slot"] < F.col("n")).alias("held"), F.get("codes", s["slot"]).alias("code"), F.get("vals", s["slot"]).alias("v"))), lambda s: s["held"])).alias("s"))
    flat = found.select("column", "run", "epoch", "s.req_pos", "s.code", "s.v")
    coded = flat.where("code is not null").drop("v").join(dictionary(encoded), ["column", "run", "epoch", "code"])
    return coded.select("req_pos", "column", "v").union(flat.where("code is null").select("req_pos", "column", "v"))


def chain(encoded: DataFrame) -> DataFrame:
    """(column, run, epoch, page, len, base): the segments of each epoch's dictionary."""
    return encoded.where("encoding != 'plain'").select("column", "run", "epoch", "page", F.size("segment").alias("len"), "base")
