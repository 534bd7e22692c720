"""Embedding near-duplicates by an epsilon grid order join.

Vectors of equal label and length are compared by cosine. For unit vectors a cosine of ``COSINE`` or more is a distance of
at most ``EPSILON``, and distances don't grow under projection on orthonormal axes. So the unit vectors are projected on
their leading principal axes, laid into grid cells of side ``EPSILON`` and sorted by cell (the epsilon grid order); the
sequence is cut into blocks, each with the bounds of its projections, on further axes too, and of the lengths that these
leave. Starting from each label's whole sequence, pairs of intervals are expanded, sixteen parts to an interval, into pairs
of their parts as long as their bounds come within ``EPSILON``; pairs of blocks that are left are compared in double
precision, sixteen blocks with sixteen in a task, which gets each of them once. The axes come from a bounded sample and
decide only how much is skipped.

Equal vectors are one class. A pair of blocks yields, for each class, how many vectors it links to, and a spanning forest
of the links, never the links themselves, so that a large group of alike vectors gives rows in proportion to it.

Edge cases: a vector that is null, empty or zero, that holds null or non-finite components, or whose label is null links
with nothing; so do vectors of different lengths. Rows with equal vec_ids count each; a null vec_id takes part and names a
component only if all its vec_ids are null. A table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import stored
from .graph import components

COSINE = 0.93
EPSILON = math.sqrt(2 - 2 * COSINE)
#: Vectors in a block, principal axes of the grid and of the bounds, vectors that the axes are fitted on at most, and values
#: among them.
BLOCK, AXES, BOUND_AXES, SAMPLE_ROWS, SAMPLE_VALUES = 256, 6, 24, 5_000, 2_000_000
#: Bits of a block's position within its partition; intervals are of 16 parts, from blocks to partitions and beyond.
_IN_PARTITION = 20
_NO_ID = (1 << 63) - 1


def _units(raw: list[np.ndarray] | np.ndarray) -> np.ndarray:
    x = np.asarray(raw, dtype=np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, dim, vec): the components as bytes, null where the vector links with nothing."""
    for batch in batches:
        out, dims = [], []
        labelled = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        lists = batch.column(2)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        for k in range(len(batch)):
            own = lists[k].values if labelled[k] and lists[k].is_valid else None
            x = own.to_numpy(zero_copy_only=False) if own is not None and not own.null_count else np.zeros(0)
            ok = len(x) > 0 and np.isfinite(x).all() and x.any()
            out.append(x.astype("<f8").tobytes() if ok else None)
            dims.append(len(x) if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "label", "dim", "vec"])


def axes_of(sample: list[bytes], most: int = BOUND_AXES) -> tuple[int, np.ndarray]:
    """The most common length among sampled vectors, and orthonormal leading principal axes (columns) for it."""
    if not sample:
        return 0, np.zeros((0, 0))
    sizes = [len(v) // 8 for v in sample]
    dim = max(sorted(set(sizes)), key=sizes.count)
    x = _units([np.frombuffer(v, "<f8") for v in sample if len(v) == 8 * dim])
    x = x - x.mean(0)
    return dim, np.linalg.svd(x, full_matrices=False)[2][:most].T if len(x) > 1 else np.eye(dim)[:, :most]


def _project(x: np.ndarray, fitted: tuple[int, np.ndarray]) -> np.ndarray:
    """Unit vectors on the axes, in BOUND_AXES columns, and the length of what these leave of them, in a last one."""
    y = x @ fitted[1] if x.shape[1] == fitted[0] else x[:, :BOUND_AXES]
    rest = np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(1)))
    return np.hstack((np.pad(y, ((0, 0), (0, BOUND_AXES - y.shape[1]))), rest[:, None]))


def _cells(fitted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros((len(batch), AXES), dtype=np.int32)
            dims = batch.column(2).to_numpy()
            raw = batch.column(3).to_pylist()
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                cell[own] = np.floor(_project(_units([np.frombuffer(raw[k], "<f8") for k in own]), fitted)[:, :AXES] / EPSILON)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cell[:, i]) for i in range(AXES))], [*batch.schema.names, *(f"g{i}" for i in range(AXES))])

    return run


def _blocks(fitted):
    """Blocks of consecutive sorted rows of one label and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        index = 0

        def block() -> pa.RecordBatch:
            nonlocal index
            raw = [np.frombuffer(r[3], "<f8") for r in held]
            y = _project(_units(raw), fitted)
            index += 1
            vecs = np.asarray(raw)
            narrow = vecs.astype("<f4")
            exact = (narrow == vecs).all()
            return pa.RecordBatch.from_arrays(
                [pa.array([held[0][1]], pa.string()), pa.array([held[0][2]], pa.int32()), pa.array([index - 1], pa.int64())] + [pa.array([np.array([r[k] for r in held], "<i8").tobytes()], pa.binary()) for k in (0, 4)]
                + [pa.array([(narrow if exact else vecs).tobytes()], pa.binary()), *(pa.array([e.tolist()], pa.list_(pa.float64())) for e in (y.min(0), y.max(0)))],
                ["label", "dim", "index", "rids", "copies", "vecs", "lo", "hi"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                if held and (len(held) == BLOCK or held[0][1:3] != row[1:3]):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    return run


def _compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Counts (a, null, n) and forest links (a, b, 0) between blocks and their partners."""
    rows, blocks, out = table.to_pylist(), {}, []
    for r in rows:
        if r["at"] not in blocks:
            n = len(r["rids"]) // 8
            x = np.frombuffer(r["vecs"], "<f4" if len(r["vecs"]) == 4 * n * r["dim"] else "<f8").reshape(n, r["dim"])
            blocks[r["at"]] = np.frombuffer(r["rids"], "<i8"), np.frombuffer(r["copies"], "<i8"), _units(x)
    links = {at: np.zeros(len(rid), dtype=np.int64) for at, (rid, _, _) in blocks.items()}
    for r in rows:
        rid, copies, x = blocks[r["at"]]
        for at in sorted(r["partners"] or []):
            other, other_copies, y = blocks[at]
            alike = x @ y.T >= COSINE
            if at == r["at"]:
                np.fill_diagonal(alike, False)
            else:
                links[at] += copies @ alike
            links[r["at"]] += alike @ other_copies
            out += _forest(alike, rid, other)
    out += [(int(blocks[at][0][k]), None, int(n[k])) for at, n in links.items() for k in np.flatnonzero(n)]
    return pa.table([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["a", "b", "n"])


def _forest(alike: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int, int]]:
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while parent.setdefault(k, k) != k:
            parent[k] = k = parent[parent[k]]
        return k

    out = []
    for i, j in zip(*(e.tolist() for e in np.nonzero(alike)), strict=True):
        a, b = int(left[i]), int(right[j])
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            out.append((a, b, 0))
    return out


def _near(x: str, y: str):
    """Whether two boxes come within EPSILON."""
    gap = F.aggregate(
        F.zip_with(F.arrays_zip(F.col(f"{x}_lo").alias("lo"), F.col(f"{x}_hi").alias("hi")), F.arrays_zip(F.col(f"{y}_lo").alias("lo"), F.col(f"{y}_hi").alias("hi")), lambda p, q: F.greatest(F.lit(0.0), p["lo"] - q["hi"], q["lo"] - p["hi"])),
        F.lit(0.0), lambda s, d: s + d * d,
    )
    return gap <= (EPSILON + 1e-9) ** 2


def _boxes(rows: DataFrame, *keys: str) -> DataFrame:
    bound = lambda f, c: F.array(*(f(F.col(c)[i]) for i in range(BOUND_AXES + 1))).alias(c)
    return rows.groupBy(*keys).agg(bound(F.min, "lo"), bound(F.max, "hi"))


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(a, b), a <= b, the positions of blocks that may hold links: interval pairs, expanded level by level."""
    top = blocks.agg(F.max("at")).first()[0] or 0
    shifts = list(range(4, _IN_PARTITION + 1, 4))
    while top >> shifts[-1]:
        shifts.append(shifts[-1] + 4)
    own = ["label", "dim"]
    boxes = blocks.select(*own, "at", "lo", "hi")
    at_level = lambda s: F.shiftright("at", s)
    pairs = boxes.select(*own, at_level(shifts[-1]).alias("a")).distinct().withColumn("b", F.col("a"))
    for upper, lower in zip(reversed(shifts), [*reversed(shifts[:-1]), 0], strict=True):
        parts = stored(_boxes(boxes.withColumn("node", at_level(lower)).withColumn("above", at_level(upper)), *own, "node", "above"), "boxes")
        x, y = (parts.select(*own, F.col("above").alias(c), F.col("node").alias(f"{c}_node"), F.col("lo").alias(f"{c}_lo"), F.col("hi").alias(f"{c}_hi")) for c in ("a", "b"))
        open_ = pairs.join(x, [*own, "a"]).join(y, [*own, "b"]).where((F.col("a_node") <= F.col("b_node")) & _near("a", "b"))
        pairs = stored(open_.select(*own, F.col("a_node").alias("a"), F.col("b_node").alias("b")), "pairs")
    return pairs.select("a", "b")


def links(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector (vec_id, embedding, label)."""
    spark = rows.sparkSession
    slim = common.narrow(rows, "vec_id", "label", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    with common.scope() as keep:
        vectors = keep(stored(slim.mapInArrow(_vectors, "vec_id long, label string, dim int, vec binary"), "vectors"))
        first = F.min(F.coalesce("vec_id", F.lit(_NO_ID))).alias("first")
        classes = vectors.where("vec is not null").groupBy("label", "dim", "vec").agg(F.count("*").alias("copies"), first)
        reps = stored(classes.select(F.monotonically_increasing_id().alias("rid"), "label", "dim", "vec", "copies", "first"), "reps")

        about = reps.agg(F.count("*"), F.max("dim")).first()
        rate = min(SAMPLE_ROWS, SAMPLE_VALUES // (about[1] or 1)) / max(about[0], 1)
        sample = reps.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1).select("vec").limit(SAMPLE_ROWS)
        fitted = axes_of([bytes(r.vec) for r in sample.collect()])

        grid = [f"g{i}" for i in range(AXES)]
        cells = reps.mapInArrow(_cells(fitted), "rid long, label string, dim int, vec binary, copies long, first long, " + ", ".join(f"{g} int" for g in grid))
        sequence = cells.repartitionByRange("label", "dim", *grid, "rid").sortWithinPartitions("label", "dim", *grid, "rid").select("rid", "label", "dim", "vec", "copies")
        made = sequence.mapInArrow(_blocks(fitted), "label string, dim int, index long, rids binary, copies binary, vecs binary, lo array<double>, hi array<double>")
        blocks = stored(made.withColumn("at", F.shiftleft(F.spark_partition_id().cast("long"), _IN_PARTITION) + F.col("index")), "blocks")

        pairs = stored(block_pairs(blocks), "pairs")
        upper = lambda c: F.shiftright(c, 4).alias(f"{c}_task")
        leads = pairs.groupBy("a", upper("b")).agg(F.collect_list("b").alias("partners")).select(upper("a"), "b_task", F.col("a").alias("at"), "partners")
        rest = pairs.select(upper("a"), upper("b"), F.col("b").alias("at")).distinct().withColumn("partners", F.lit(None).cast("array<long>"))
        asked = leads.union(rest).join(blocks.select("at", "dim", "rids", "copies", "vecs"), "at")
        found = stored(asked.groupBy("a_task", "b_task").applyInArrow(_compare, "a long, b long, n long"), "found")

        counts = found.where("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n"))
        root = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rid")
        placed = keep(stored(reps.join(counts, "rid", "left").join(root, "rid", "left").select("label", "vec", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rid").alias("root")), "placed"))
    heads = placed.groupBy("root").agg(F.min("first").alias("head"))
    result = placed.join(heads, "root").select(F.col("vec").alias("key"), F.col("label").alias("key_label"), "n_links", "head")
    # Rows that link with nothing take a key of their own, so that they don't meet in one task.
    lone = F.col("vec").isNull()
    keyed = vectors.select("vec_id", F.coalesce("vec", F.col("vec_id").cast("string").cast("binary"), F.lit(b"")).alias("key"), F.when(lone, F.lit("")).otherwise(F.col("label")).alias("key_label"), lone.alias("lone"))
    joined = keyed.join(result.withColumn("lone", F.lit(False)), ["key", "key_label", "lone"], "left")
    head = F.when(F.col("lone") | (F.col("head") == _NO_ID), F.col("vec_id")).otherwise(F.col("head"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), head.alias("component_id"), F.col("vec_id").eqNullSafe(head).alias("kept"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(common.table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """op4 as DuckDB SQL, for tables without null ids and values: all pairs, then the closure of those linked."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= {COSINE}),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""
