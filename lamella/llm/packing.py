"""Packing by power-of-two decomposition.

A document of n tokens, with its end token, is cut into pieces whose lengths are the powers of two in n: as many of the
longest length as fit, then the binary digits of the rest, the longest first. Each piece is a sequence of its own, so that
no sequence crosses documents and none needs padding; pieces of one length form a bucket from which batches are drawn.

Nothing is shuffled: documents are tokenized where they are read and a sequence's id comes from its partition and row.

Edge cases: a null or empty text is the end token alone; equal rows are packed each on its own; a document of any length
is cut whole; a table without rows gives none; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

LONGEST, END = 4096, 2
_TEXT_AT_ONCE = 1 << 20


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The lengths of a document's pieces: powers of two up to ``longest``, itself one, that add up to ``n``."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def _pieces(path: str, longest: int, end: int):
    tail = np.uint32(end).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = tokens.WordCache(path)  # a task's own: workers live on, and its room with them
        for batch in batches:
            for part in _portions(batch):
                ids, texts = (c.to_pylist() for c in part.columns)
                yield _cut(ids, [x + tail for x in cache.encode(texts)], longest)

    return run


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in portions of about _TEXT_AT_ONCE bytes of text, a longer text alone or with shorter ones before it."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    of = (np.cumsum(size, dtype=np.int64) - size) // _TEXT_AT_ONCE
    edges = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else []
    for a, b in itertools.pairwise(edges):
        yield batch.slice(a, b - a)


def _cut(doc_ids: list[int | None], encoded: list[bytes], longest: int) -> pa.RecordBatch:
    doc, start, length, total, parts = [], [], [], [], []
    for doc_id, ids in zip(doc_ids, encoded, strict=True):
        n, at = len(ids) // 4, 0
        for size in lengths(n, longest):
            doc.append(doc_id)
            start.append(at)
            length.append(size)
            total.append(n)
            parts.append(ids[4 * at : 4 * (at + size)])
            at += size
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(parts, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])


def pack(docs: DataFrame, path: str, longest: int = LONGEST, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), bucket (log2 of the
    length), sequence_id and offset, which is 0 as each sequence holds one piece."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length has to be a power of two")
    slim = common.narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = slim.mapInArrow(_pieces(path, longest, end), "doc_id long, start long, length long, doc_tokens long, ids binary")
    return cut.withColumns({"bucket": (F.length(F.bin("length")) - 1).cast("int"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, folder: str) -> None:
    """The sequences as Parquet, one folder for each length."""
    packed.write.partitionBy("bucket").parquet(folder)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(common.table(spark, sf_dir, "documents"), tokens.public("word_bpe_49k.json")))
