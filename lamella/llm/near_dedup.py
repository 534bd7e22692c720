"""Near-duplicates by DartMinHash signatures and a banded join.

A document is the weighted set of its shingles of five words (its only shingle is the whole word sequence if it has
fewer); a shingle weighs as often as it occurs, and the similarity of two documents is the weighted Jaccard similarity, the
sum of the lesser weights over that of the greater. Darts are thrown by hashing into the plane of each element, of weight by rank: unit cells (layer of weight,
interval of rank) each receive a Poisson(1) number of them at positions that depend on element and cell alone. A dart
under the element's weight hits one of ``COORDINATES`` coordinates, and the coordinate keeps its dart of least rank.
Two sets agree in a coordinate with a probability of their weighted Jaccard similarity. Ranks need to be drawn only up
to about ``k ln k / weight``, so a long document costs little more than its shingles; where a coordinate stays empty
the interval of ranks is extended until it is hit.

Documents with equal weighted sets form one class at once. Class signatures meet in ``BANDS`` bands of ``ROWS``
coordinates. Within a bucket, members are compared with a centre (another one for each band), by their shingles; members
of a bucket that this leaves in different components are then compared block by block. The members of a bucket of over
``LARGE`` meet anew beforehand, by the rarest of their shingles: alike sets share one of as few of these as the similarity
lets them differ in, and one more, so that unlike documents with a common passage don't meet. Linked classes make groups by
connected components. Each document learns its group's least doc_id.

Edge cases: a document without words (null, empty, blank) is its own group; with 1 to 4 words it equals only the same
words; ties and repeated rows share a group, of which one row is kept; a table without rows gives none; a null doc_id takes part but names a group
only if all its doc_ids are null; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import mix, stored
from .graph import components

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 7
COORDINATES = BANDS * ROWS
#: Members and elements on each side of a comparison between components of one bucket, about; members of a large bucket.
BLOCK, BLOCK_ELEMENTS, LARGE = 128, 1 << 18, 512
_U = np.uint64
_NO_ID = (1 << 63) - 1
_EMPTY = _U((1 << 64) - 1)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def shingles(part: common.Slice, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, their documents and how often they occur there, by document."""
    start, end, doc = part.words()
    if not len(start):
        return np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    word = part.hashes(start, end)
    at = common.runs(doc, width)
    found, of = [common.window_hashes(word, at, width)], [doc[at]]
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    count = np.diff(np.append(first, len(doc)))
    for k in range(1, width):
        short = first[count == k]
        found.append(common.window_hashes(word, short, k))
        of.append(doc[short])
    h, d = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
    return h[new], d[new], np.diff(np.append(new, len(h)))


def elements(h: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A weighted set as a set: a hash for each occurrence, the first, the second and so on, sorted."""
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    return np.sort(np.where(nth == 0, np.repeat(h, times), mix(np.repeat(h, times) + nth.astype(_U) * _U(0x9FB21C651E98DF25))))


def signatures(h: np.ndarray, doc: np.ndarray, n: int, k: int = COORDINATES, weight: np.ndarray | None = None) -> np.ndarray:
    """n x k signatures; ``h`` are the elements, ``doc`` their sets; ``weight`` over 0, 1 where it is not given."""
    out = np.full(n * k, _EMPTY, dtype=_U)
    w = np.ones(len(h)) if weight is None else weight
    total = np.bincount(doc, weights=w, minlength=n)
    upto = np.ceil((k * math.log(k) + 2 * k) / np.maximum(total, 1e-9)).astype(np.int64)
    begin, todo = np.zeros(n, dtype=np.int64), total > 0
    layers = np.ceil(w).astype(np.int64)
    fractions = bool((layers != w).any())
    while todo.any():
        live = np.flatnonzero(todo[doc])
        ranks = (upto - begin)[doc[live]]
        for element, layer in _portions(layers[live], ranks):
            _throw(out, h, doc, w, live[element], layer, begin, upto, k, fractions)
        todo &= (out.reshape(n, k) == _EMPTY).any(1)
        begin, upto = upto, upto * 2
    return out.reshape(n, k)


def _portions(layers: np.ndarray, ranks: np.ndarray, cells: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The layers of all elements, (element, layer), in portions of about as many cells; a heavy element is cut too."""
    upto, held = np.cumsum(layers * ranks), np.cumsum(layers)
    at = np.arange(0, int(upto[-1]), cells)
    e = np.searchsorted(upto, at, side="right")
    edge = np.append(held[e] - layers[e] + (at - (upto[e] - layers[e] * ranks[e])) // ranks[e], held[-1])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        nth = np.arange(a, b)
        element = np.searchsorted(held, nth, side="right")
        yield element, nth - (held[element] - layers[element])


def _throw(out, h, doc, w, element, layer, begin, upto, k, fractions) -> None:
    """Darts of layers of elements, with ranks from begin to upto; only a layer that a weight cuts can let a dart miss."""
    ranks = (upto - begin)[doc[element]]
    cell = np.repeat(np.arange(len(element)), ranks)
    c = (np.arange(len(cell)) - np.repeat(np.cumsum(ranks) - ranks, ranks) + begin[doc[element]][cell]).astype(_U)
    hashed = mix(h[element][cell] + c * _U(0xD6E8FEB86659FD93) + layer[cell].astype(_U) * _U(0xA0761D6478BD642F))
    n = np.searchsorted(_POISSON, (hashed >> _U(11)).astype(np.float64) / (1 << 53), side="right")
    dart = np.repeat(np.arange(len(cell)), n)
    q = (np.arange(len(dart)) - np.repeat(np.cumsum(n) - n, n) + 1).astype(_U)
    place = mix(hashed[dart] + q * _U(0xE7037ED1A0B428DB))
    of = cell[dart]
    if fractions:
        under = layer[of] + (mix(place) >> _U(11)).astype(np.float64) / (1 << 53) < w[element[of]]
        dart, place, of = dart[under], place[under], of[under]
    rank = c[dart] << _U(24) | place >> _U(40)
    key = doc[element[of]] * k + (((place & _U(0xFFFFFFFF)) * _U(k)) >> _U(32)).astype(np.int64)
    np.minimum.at(out, key, rank << _U(24) | (place >> _U(16)) & _U(0xFFFFFF))


def bands(sig: np.ndarray) -> np.ndarray:
    """n x BANDS hashes of the coordinates of each band."""
    cut = sig.reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(mix(np.arange(BANDS, dtype=_U) + _U(77)), cut.shape[:2]).copy()
    for r in range(ROWS):
        out = mix(out * _U(0x9E3779B97F4A7C15) + cut[:, :, r])
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, t) and the class, a hash of the weighted set, with its bands; null where there are no words."""
    for batch in batches:
        cls, size, band = np.zeros(len(batch), dtype=_U), np.zeros(len(batch), dtype=np.int64), np.zeros((len(batch), BANDS), dtype=_U)
        for part in common.slices(batch.column(2)):
            own = slice(part.first, part.first + part.n)
            h, d, times = shingles(part)
            size[own] = np.bincount(d, minlength=part.n)
            key = np.zeros(part.n, dtype=_U)
            np.add.at(key, d, mix(h + times.astype(_U) * _U(0xD1342543DE82EF95)))
            cls[own] = key
            # Equal sets in a slice get one signature.
            _, lead, back = np.unique(key, return_index=True, return_inverse=True)
            leads = np.zeros(part.n, dtype=bool)
            leads[lead] = True
            inner = np.cumsum(leads) - 1
            kept = leads[d]
            band[own] = bands(signatures(h[kept], inner[d[kept]], len(lead), weight=times[kept].astype(float)))[inner[lead]][back]
        none = size == 0
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(batch) * BANDS + 1, BANDS), pa.int32()), pa.array(band.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cls.view(np.int64), mask=none), lists], ["doc_id", "t", "cls", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, set, size) of texts: the sorted 64-bit elements as bytes, and their number."""
    for batch in common.some(batches):
        out, size = [b""] * len(batch), [0] * len(batch)
        for part in common.slices(batch.column(1)):
            h, d, times = shingles(part)
            cut = np.searchsorted(d, np.arange(part.n + 1))
            for k in range(part.n):
                own = elements(h[cut[k] : cut[k + 1]], times[cut[k] : cut[k + 1]])
                out[part.first + k], size[part.first + k] = own.tobytes(), len(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(size, pa.int64())], ["cls", "set", "size"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets have a Jaccard similarity of SIMILARITY or more."""
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        keep = np.zeros(len(batch), dtype=bool)
        for k in range(len(batch)):
            x, y = (np.frombuffer(s[k].as_buffer(), dtype=_U) for s in (left, right))
            if min(len(x), len(y)) >= SIMILARITY * max(len(x), len(y)) - 1e-6:
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common_ = int((both[1:] == both[:-1]).sum())
                keep[k] = common_ >= SIMILARITY * (len(x) + len(y) - common_) - 1e-6
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose shingles are alike."""
    left = sets.select(F.col("cls").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_alike, "a long, b long")


def _open(placed: DataFrame) -> DataFrame:
    """The members (bucket, cls, root, size) of buckets that hold several components, with n, the bucket's members, ``main``,
    the component of most of them, in_main, how many those are, and most, the elements of the largest."""
    parts = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    about = parts.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("in_main"), F.max("size").alias("most"))
    # Stored, so that the join has nothing but shuffles under it and a large bucket can be split.
    return stored(placed.join(stored(about.where("in_main < n"), "about"), "bucket"), "open")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(element, cls, root, size) of sets."""
    for batch in common.some(batches, 64):
        sets = [np.frombuffer(s, dtype=np.int64) for s in batch.column(2).to_pylist()]
        sizes = [len(s) for s in sets]
        each = [pa.array(np.repeat(c.to_numpy(zero_copy_only=False), sizes)) for c in (batch.column(0), batch.column(1), batch.column(3))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, dtype=np.int64)])), *each], ["element", "cls", "root", "size"])


def _by_rarest(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, cls, root, size): members by those of their rarest elements of which alike sets share one.

    In any common order of elements, two sets with a similarity of SIMILARITY share one of the first size - SIMILARITY * size
    + 1 of each. The order is by the number of members that hold an element, so most sets begin with elements of their own,
    which need no bucket.
    """
    one = members.select("cls", "root").distinct().join(sets.select("cls", "set", "size"), "cls")
    held = stored(one.select("cls", "root", "set", "size").mapInArrow(_told, "element long, cls long, root long, size long"), "held")
    shared = held.groupBy("element").agg(F.count("*").alias("n")).where("n > 1")
    own = held.join(shared, "element").groupBy("cls", "root", "size").agg(F.array_sort(F.collect_list(F.struct("n", "element"))).alias("l"))
    first = F.col("size") - F.ceil(SIMILARITY * F.col("size") - 1e-6) + 1 - (F.col("size") - F.size("l"))  # less those that it has alone
    return own.where(first > 0).select(F.explode(F.slice("l", F.lit(1), first.cast("int"))).alias("e"), "cls", "root", "size").select(F.col("e.element").alias("bucket"), "cls", "root", "size")


def _across(met: DataFrame, root: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of one bucket that the centres left in different components.

    Members outside a bucket's largest component are compared with all others, in blocks of about BLOCK a side, fewer where
    sets are large, so that tasks stay small; a block yields only the links that join components, never its pairs.
    """
    sized = met.select("bucket", "cls").join(sets.select("cls", "size"), "cls")
    placed = sized.join(root.withColumnRenamed("node", "cls"), "cls", "left").select("bucket", "cls", F.coalesce("root", "cls").alias("root"), "size")
    left = _open(placed).where("n > 2")  # with two members, the centre has been compared with the only other
    again = _open(_by_rarest(left.where(F.col("n") > LARGE), sets))
    some = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.lit(BLOCK_ELEMENTS) / F.col("most")))
    blocks = lambda n: F.ceil(n / some).cast("int")
    cut = lambda rows: rows.select("bucket", "cls", "root", "main", blocks(F.col("n")).alias("wide"), blocks(F.col("n") - F.col("in_main")).alias("deep"))
    open_ = cut(left.where(F.col("n") <= LARGE)).union(cut(again))
    mine = lambda salt, n: F.pmod(F.xxhash64("cls", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lead = open_.where("root != main").select("bucket", mine(5, "deep").alias("i"), each("wide").alias("j"), F.lit(True).alias("lead"), "cls", "root")
    rest = open_.select("bucket", each("deep").alias("i"), mine(6, "wide").alias("j"), F.lit(False).alias("lead"), "cls", "root")
    rows = lead.union(rest).join(sets.select("cls", "set"), "cls").select("bucket", "i", "j", "lead", "cls", "root", "set")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_compare, "a long, b long")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join components, from rows sorted by block."""
    held, key = [], None

    def found(rows: list[tuple]) -> pa.RecordBatch:
        left, right = ([r for r in rows if r[3] is lead] for lead in (True, False))
        out, parent = [], {}

        def top(k: int) -> int:
            while parent.setdefault(k, k) != k:
                parent[k] = k = parent[parent[k]]
            return k

        if left and right:
            x, y = ([np.frombuffer(r[6], dtype=_U) for r in side] for side in (left, right))
            for i, j in zip(*(e.tolist() for e in np.nonzero(_similar(x, y))), strict=True):
                a, b = top(left[i][5]), top(right[j][5])
                if a != b:
                    parent[a] = b
                    out.append((left[i][4], right[j][4]))
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != key:
                if held:
                    yield found(held)
                held, key = [], row[:3]
            held.append(row)
    if held:
        yield found(held)


def _similar(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Which of the sets x are alike with which of y, by counts of common elements over stretches of their union."""
    n, m = (np.array([len(s) for s in side]) for side in (x, y))
    element, back = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), np.concatenate((n, m)))
    order = np.argsort(back, kind="stable")
    back, row = back[order], row[order]
    both = np.zeros((len(x), len(y)), dtype=np.float32)
    for begin in range(0, len(element), 8192):
        lo, hi = np.searchsorted(back, (begin, begin + 8192))
        held = np.zeros((len(x) + len(y), 8192), dtype=np.float32)
        held[row[lo:hi], back[lo:hi] - begin] = 1
        both += held[: len(x)] @ held[len(x) :].T
    return both >= SIMILARITY * (n[:, None] + m[None, :] - both) - 1e-3


def classes(docs: DataFrame) -> DataFrame:
    """The documents as (doc_id, t, rid, cls, bands): t is a hash of the text, rid tells equal rows apart. Stored, as the
    steps below read it again, so that a row keeps its rid."""
    slim = common.narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = slim.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(_sign, "doc_id long, t long, cls long, bands array<long>")
    return stored(signed.select("doc_id", "t", F.monotonically_increasing_id().alias("rid"), "cls", "bands"), "sign")


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: d (its doc_id), t, rid, cls, head (d, t and rid of the row that stands for its group), n_group."""
    with common.scope() as keep_:
        signed = classes(docs)
        one = signed.where("cls is not null").groupBy("cls").agg(F.min(F.struct(_whole("doc_id").alias("d"), "t")).alias("first"), F.first("bands").alias("bands"))
        lone = stored(one.select("cls", "first.d", "first.t", "bands"), "classes")
        member = lone.select("cls", F.explode("bands").alias("bucket"))
        lot = lambda salt: F.xxhash64("cls", "bucket", F.lit(salt))
        full = member.groupBy("bucket").agg(F.count("*").alias("n"), F.min(lot(1)).alias("lot")).where("n > 1").select("bucket", "lot")
        met = stored(member.join(full, "bucket").select("bucket", "cls", (lot(1) == F.col("lot")).alias("centre")), "met")
        centre = met.where("centre").select("bucket", F.col("cls").alias("b"))
        star = met.where("not centre").select("bucket", F.col("cls").alias("a")).join(centre, "bucket")
        pairs = stored(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

        wanted = lone.join(met.select("cls").distinct(), "cls").select("cls", "d", "t")
        own = common.narrow(docs, "doc_id", "text").select(_whole("doc_id").alias("d"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("text").cast("string").alias("text"))
        # Repeated rows give a set twice; it is stored once, so that the joins below have nothing but shuffles under them.
        sets = stored(own.join(wanted, ["d", "t"]).select("cls", "text").mapInArrow(_sets, "cls long, set binary, size long").dropDuplicates(["cls"]), "sets")

        links = stored(_verified(pairs, sets), "links")
        root = components(links)
        more = stored(_across(met, root, sets), "links")
        if more.limit(1).count():
            root = components(links.union(more))

        grouped = signed.select(_whole("doc_id").alias("d"), "t", "rid", "cls").join(root.withColumnRenamed("node", "cls"), "cls", "left").select("d", "t", "rid", "cls", F.coalesce("root", "cls").alias("root"))
        # Stored, so that the join below has nothing but shuffles under it and a large group can be split.
        heads = stored(grouped.where("root is not null").groupBy("root").agg(F.min(F.struct("d", "t", "rid")).alias("head"), F.count("*").alias("n_group")), "heads")
        for kept in (signed, root, heads):
            keep_(kept)
    # Documents without words have no class: they take a key of their own, so that they don't meet in one task.
    keyed = grouped.withColumn("root", F.coalesce("root", F.xxhash64("d", F.lit("blank"))))
    own = F.when(F.col("cls").isNotNull(), F.col("head"))
    head = F.coalesce(own, F.struct("d", "t", "rid"))
    return keyed.join(heads, "root", "left").select(
        "d", "t", "rid", "cls", head.alias("head"), F.when(own.isNotNull(), F.col("n_group")).otherwise(1).cast("long").alias("n_group")
    )


def _whole(name: str) -> Column:
    """A null doc_id as the greatest long, for joins and to come last."""
    return F.coalesce(F.col(name).cast("long"), F.lit(_NO_ID))


def _back(c: Column) -> Column:
    return F.when(c != _NO_ID, c)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(common.table(spark, sf_dir, "documents"))
    return found.select(_back(F.col("d")).alias("doc_id"), _back(F.col("head.d")).alias("class_id"), F.col("n_group").alias("class_size"), (F.col("rid") == F.col("head.rid")).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: that of the least doc_id; of rows with equal doc_ids and texts, one."""
    chosen = groups(docs).where(F.col("rid") == F.col("head.rid")).select("d", "t").distinct()
    own = docs.columns
    flat = docs.toDF(*(f"_{i}" for i in range(len(own))))
    keyed = flat.withColumn("d", _whole(f"_{own.index('doc_id')}")).withColumn("t", F.xxhash64(F.col(f"_{own.index('text')}").cast("string")))
    return keyed.join(chosen, ["d", "t"]).dropDuplicates(["d", "t"]).drop("d", "t").toDF(*own)


def oracle() -> str:
    """op7 as DuckDB SQL: the similarity of pairs that share a shingle, then the closure of those alike."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, s, count(*) AS m FROM (SELECT doc_id, array_to_string(w[i : i + {WIDTH - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 2}, 2))) AS i FROM d WHERE len(w) > 0)) GROUP BY 1, 2),
n AS (SELECT doc_id, sum(m) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.m, y.m)) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {SIMILARITY} * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
g AS (SELECT a AS doc_id, min(b) AS class_id, count(*) AS class_size FROM r GROUP BY 1)
SELECT doc_id, class_id, class_size, doc_id = class_id AS kept FROM g"""
