"""What the training-data operators share: column picking, scratch tables and a NumPy text kernel.

A *word* here is a maximal run of characters other than space and ``\\t\\n\\v\\f\\r``. The kernel works on
UTF-8 bytes, where none of those characters can be part of a longer one, and hashes words with a polynomial
over 64 bits, so that no Python object is made for a word.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the kernel works on at once; a longer document is worked on alone.
SLICE_BYTES = 1 << 19

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)

_scratch: list[tuple[SparkSession, str]] = []


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns ``names``, by exact spelling and first occurrence, whatever else the table holds.

    A table may hold further columns whose names differ by case only or repeat; picking by position avoids
    ambiguous references.
    """
    own = df.columns
    flat = df.toDF(*(f"_{i}" for i in range(len(own))))
    missing = [n for n in names if n not in own]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {own}")
    return flat.select(*(F.col(f"_{own.index(n)}").alias(n) for n in names))


def kept_rows(docs: DataFrame, verdict: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows whose texts, as an Arrow array, get a true verdict, with all their columns, however those are named."""
    own = docs.columns
    flat, at = docs.toDF(*(f"_{i}" for i in range(len(own)))), own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(verdict(batch.column(at)), pa.bool_()))

    return flat.mapInArrow(run, flat.schema).toDF(*own)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, which the session names; a local one of our own only in a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lamella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a compressed table in the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lamella-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _scratch.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._lamella_path = path
    return back


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables stored within it at its end, but for those that the yielded function is given."""
    mark, kept = len(_scratch), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._lamella_path)
        return df

    yield keep
    own = _scratch[mark:]
    _scratch[mark:] = [x for x in own if x[1] in kept]
    _delete([x for x in own if x[1] not in kept])


def free(df: DataFrame) -> None:
    """Delete a stored table."""
    path = getattr(df, "_lamella_path", None)
    own = [x for x in _scratch if x[1] == path]
    _scratch[:] = [x for x in _scratch if x[1] != path]
    _delete(own)


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Delete the scratch tables of this process; results that still depend on them can't be read afterwards."""
    own, _scratch[:] = list(_scratch), []
    try:
        _delete(own)
    except Exception:  # noqa: BLE001  the session may have ended, at exit
        return


atexit.register(release)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 2 * len(_powers))
        full = np.full(n, BASE, dtype=np.uint64)
        full[0] = 1
        _powers = np.cumprod(full, dtype=np.uint64)
        full[1:] = pow(BASE, -1, 1 << 64)
        _inverse = np.cumprod(full, dtype=np.uint64)


class Slice:
    """Some documents as one run of bytes, each followed by a space.

    ``starts[d]`` to ``ends[d]`` are the bytes of document ``first + d``.
    """

    def __init__(self, first: int, texts: list[bytes]):
        self.first, self.n = first, len(texts)
        self.data = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=self.n)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self._prefix = None

    def polynomials(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The values of the byte ranges as polynomials in ``BASE``: that of two ranges in a row is that of the first, plus
        the second's times ``BASE`` to the power of the first's length."""
        if self._prefix is None:
            _grow(len(self.data) + 1)
            self._prefix = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(_TABLE[self.data] * _powers[: len(self.data)], out=self._prefix[1:])
        return (self._prefix[end] - self._prefix[start]) * _inverse[start]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges; equal bytes give equal hashes."""
        return mix(self.polynomials(start, end) + (end - start).astype(np.uint64))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each word, in order."""
        gap = _SEPARATOR[self.data]
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
        start, end = edge[::2], edge[1::2]
        return start, end, np.searchsorted(self.starts, start, side="right") - 1


def _raw(texts: pa.Array) -> Iterator[bytes | None]:
    for k in range(0, len(texts), 256):
        yield from texts.slice(k, 256).cast(pa.large_binary()).to_pylist()


def some(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, as Python's copies of texts take much more room than Arrow's."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


def slices(texts: Iterable[str | bytes | None] | pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Whole documents in slices of about ``size`` bytes; a null text counts as empty."""
    if isinstance(texts, (pa.Array, pa.ChunkedArray)):
        texts = _raw(texts)
    first, held, held_size = 0, [], 0
    for k, text in enumerate(texts):
        raw = b"" if text is None else text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
        if held and held_size + len(raw) > size:
            yield Slice(first, held)
            first, held, held_size = k, [], 0
        held.append(raw)
        held_size += len(raw)
    if held:
        yield Slice(first, held)


def cut_after(data: np.ndarray, begin: int, near: int) -> int:
    """The place behind the last separator between ``begin`` and ``near``; without one, behind the next, or the end."""
    if near >= len(data):
        return len(data)
    gaps = np.flatnonzero(_SEPARATOR[data[begin:near]])
    if len(gaps):
        return begin + int(gaps[-1]) + 1
    while near < len(data):
        gaps = np.flatnonzero(_SEPARATOR[data[near : near + SLICE_BYTES]])
        if len(gaps):
            return near + int(gaps[0]) + 1
        near += SLICE_BYTES
    return len(data)


def runs(doc: np.ndarray, width: int) -> np.ndarray:
    """Indices of the words at which a window of ``width`` words of one document begins."""
    n = len(doc) - width + 1
    return np.flatnonzero(doc[:n] == doc[width - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)


def window_hashes(word: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(BASE) + word[at + k])
    return out
