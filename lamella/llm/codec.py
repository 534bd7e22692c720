"""BPE encoding over a table of distinct words, and decoding through an id-to-piece table.

Encoding goes in four steps. (1) Documents are gathered, where they are read, into chunks of about ``CHUNK_CHARS``
characters; a chunk holds its distinct words once, dealt into buckets by their hashes, and its documents as positions into
them. (2) The chunks' words meet by bucket, where each distinct word is encoded once, whichever chunks it is in. Buckets
pass one after the other, and there are so many that the words of one are few; a word of over ``LONGEST_KEPT`` characters
is encoded wherever it is asked for. (3) The ids return to the chunks in the order in which the words left. (4) Each chunk
joins them into its documents' ids by position. Whole texts are never moved, only compressed positions and words that are
distinct within their chunk.

Steps 1 and 4 read the documents once each and must see the same chunks, so a plan of anything but scans, filters and
deterministic columns is stored first; a chunk that would still differ is missed by its id and raises an error.

Decoding looks ids up in the vocabulary's table of pieces (bounded by the vocabulary and so sent to every task), joins the
pieces' bytes and reads them as UTF-8, with the replacement character for what is none.

Edge cases: a null text counts as empty and has no ids; a special token's string in a text becomes that token, as in the
library; texts without spaces are one word; one document longer than a chunk is a chunk of its own; repeated rows each
give a row; tables without rows give none; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import common, tokens

CHUNK_CHARS = 4_000_000
#: Bytes of stored documents for each bucket of words, and the longest words that a bucket keeps.
BUCKET_BYTES, LONGEST_KEPT = 4_000_000, 4_096
_TOKENS_AT_ONCE = 1_000_000


def _squeeze(x: np.ndarray) -> bytes:
    """Compressed 32-bit integers, byte plane by byte plane."""
    return zstandard.ZstdCompressor(level=3).compress(x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _spread(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).reshape(-1).view("<i4")


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int | None], list[str], np.ndarray, np.ndarray]]:
    """(chunk id, doc_ids, distinct words, words of each document, their places among the distinct words)."""
    place: defaultdict[str, int] = defaultdict()
    place.default_factory = place.__len__
    ids, parts, held, n = [], [], 0, 0
    partition = TaskContext.get().partitionId()

    def closed():
        sizes = np.fromiter(map(len, parts), dtype=np.int32, count=len(parts))
        at = np.concatenate([*parts, np.zeros(0, dtype=np.int32)])
        seal = hashlib.blake2b(repr((partition, n, ids)).encode(), digest_size=8)
        for part in (sizes, at):
            seal.update(part.tobytes())
        return int.from_bytes(seal.digest(), "little", signed=True), ids, list(place), sizes, at

    for part in common.some(batches):
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            if ids and held + len(text or "") > CHUNK_CHARS:
                yield closed()
                place.clear()
                ids, parts, held, n = [], [], 0, n + 1
            words = tokens.split(text) if text else []
            ids.append(doc_id)
            parts.append(np.fromiter(map(place.__getitem__, words), dtype=np.int32, count=len(words)))
            held += len(text or "")
    if ids:
        yield closed()


def _dealt(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' places, ordered by bucket and word, and where each bucket begins."""
    bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words), dtype=np.int64, count=len(words))
    by_word = np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)
    order = by_word[np.argsort(bucket[by_word], kind="stable")]
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _requests(buckets: int):
    """(bucket, chunk, words): the distinct words of a chunk, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for chunk, _, words, _, _ in _chunked(batches):
            order, begin = _dealt(words, buckets)
            full = np.flatnonzero(np.diff(begin))
            # Words are joined by a zero byte; those that hold one are escaped, and so is the escape.
            sent = [press.compress("\0".join([words[k].replace("\1", "\1\1").replace("\0", "\1\2") for k in order[begin[b] : begin[b + 1]].tolist()]).encode("utf-8", "surrogatepass")) for b in full.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([chunk] * len(full), pa.int64()), pa.array(sent, pa.binary())], ["bucket", "chunk", "words"])

    return run


def _placed(buckets: int):
    """(chunk, doc_ids, and the chunk's document sizes, places, and order of words as sent)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, words, sizes, at in _chunked(batches):
            order, _ = _dealt(words, buckets)
            packed = [pa.array([_squeeze(x)], pa.binary()) for x in (sizes, at, order)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *packed], ["chunk", "doc_ids", "sizes", "places", "order"])

    return run


def _unescaped(raw: bytes) -> list[str]:
    text = zstandard.ZstdDecompressor().decompress(raw).decode("utf-8", "surrogatepass")
    if "\1" not in text:
        return text.split("\0")
    return [re.sub("\1([\1\2])", lambda m: "\1" if m[1] == "\1" else "\0", w) for w in text.split("\0")]


def _answers(path: str):
    """(chunk, bucket, sizes, ids) of each request, which come sorted by bucket. Each distinct word of a bucket is encoded
    once; what is held is the distinct words of one bucket and a request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known, at = tokens.load(path), {}, None
        for batch in common.some(batches, 1):
            if (bucket := batch.column(0)[0].as_py()) != at:
                known, at = {}, bucket
            words = _unescaped(batch.column(2)[0].as_py())
            new = [w for w in words if w not in known]  # distinct, as they come from one chunk
            known.update(zip(new, tokens.encode_words(tokenizer, new), strict=True))
            found = [known[w] for w in words]
            for w in new:
                if len(w) > LONGEST_KEPT:
                    del known[w]
            sizes = _squeeze(np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4)
            ids = _squeeze(np.frombuffer(b"".join(found), dtype="<u4"))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array([sizes], pa.binary()), pa.array([ids], pa.binary())], ["chunk", "bucket", "sizes", "ids"])

    return run


def _joined(pieces_=None):
    """The ids of a chunk's documents; with a table of pieces sent to all tasks, also the texts that they decode to."""

    def run(key: tuple[pa.Scalar, ...], chunk: pa.Table, coded: pa.Table) -> pa.Table:
        doc_ids, n_tokens, ids = _own_ids(chunk, coded)
        own = {"doc_id": doc_ids, "n_tokens": pa.array(n_tokens), "ids": pa.array(ids, pa.binary())}
        return pa.table(own if pieces_ is None else own | {"text": pa.array(_texts(ids, *pieces_.value), pa.string())})

    return run


def _own_ids(chunk: pa.Table, coded: pa.Table) -> tuple[pa.Array, np.ndarray, list[bytes]]:
    coded = coded.sort_by("bucket")
    none = np.zeros(0, dtype="<i4")
    size = np.concatenate([none, *(_spread(x.as_py()) for x in coded.column("sizes"))]).astype(np.int64)
    ids = np.concatenate([none, *(_spread(x.as_py()) for x in coded.column("ids"))]).view("<u4")
    if chunk.num_rows != 1 or len(order := _spread(chunk.column("order")[0].as_py())) != len(size):
        raise RuntimeError("the documents came in another order when they were read again")
    docs, places = (_spread(chunk.column(c)[0].as_py()) for c in ("sizes", "places"))
    starts, sizes = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
    starts[order], sizes[order] = np.cumsum(size) - size, size
    n, out, n_tokens, upto = len(docs), [], [], np.concatenate(([0], np.cumsum(docs, dtype=np.int64)))
    begin = 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + _TOKENS_AT_ONCE, side="right")) - 1)
        own = places[upto[begin] : upto[end]]
        edge = np.concatenate(([0], np.cumsum(sizes[own])))[upto[begin : end + 1] - upto[begin]]
        raw = gather(ids, starts[own], sizes[own]).tobytes()
        out += [raw[4 * a : 4 * b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        n_tokens.append(np.diff(edge))
        begin = end
    return chunk.column("doc_ids")[0].values, np.concatenate(n_tokens), out


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of ``values``, one after the other."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def _repeatable(df: DataFrame) -> bool:
    """Whether a plan gives the same rows in the same order whenever it is run: deterministic columns and filters of scans."""
    run = df._jdf.queryExecution()
    todo, plain = [run.sparkPlan()], run.analyzed().deterministic()
    while todo and plain:
        node = todo.pop()
        plain = re.match("Project$|Filter$|Scan (parquet|orc)|LocalTableScan|BatchScan", node.nodeName()) is not None
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return plain


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of each document; ``decoded``: and the text that its ids
    decode to, found where the ids are put together, so that they needn't pass through a second Python worker."""
    spark = docs.sparkSession
    slim = common.narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not _repeatable(slim):
        slim = common.stored(slim, "documents")
    size = int(str(slim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // BUCKET_BYTES, 1 << 20))
    asked = slim.mapInArrow(_requests(buckets), "bucket int, chunk long, words binary")
    coded = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answers(path), "chunk long, bucket int, sizes binary, ids binary")
    own = slim.mapInArrow(_placed(buckets), "chunk long, doc_ids array<long>, sizes binary, places binary, order binary")
    join, text = (_joined(_sent(spark, path)), ", text string") if decoded else (_joined(), "")
    return own.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(join, f"doc_id long, n_tokens long, ids binary{text}")


def pieces(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; special tokens are their text."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    table = {i: bytes(map(code.__getitem__, piece)) for piece, i in own["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in own["added_tokens"]}
    return [table.get(i, b"") for i in range(max(table, default=-1) + 1)]


def _sent(spark: SparkSession, path: str):
    """The table of pieces, for all tasks: its bytes, and each id's start and size in them."""
    table = pieces(path)
    size = np.fromiter(map(len, table), dtype=np.int64, count=len(table))
    return spark.sparkContext.broadcast((np.frombuffer(b"".join(table), dtype=np.uint8), np.cumsum(size) - size, size))


def _texts(raws: Iterable[bytes | pa.Buffer], flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[str]:
    """What ids decode to."""
    out = []
    for raw in raws:
        ids, parts = np.frombuffer(raw, dtype="<u4"), []
        for k in range(0, len(ids), _TOKENS_AT_ONCE):
            some = ids[k : k + _TOKENS_AT_ONCE]
            parts.append(gather(flat, starts[some], sizes[some]).tobytes())
        out.append(b"".join(parts).decode("utf-8", "replace"))
    return out


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of ``encoded``, which holds ``ids``, and ``text``, in place of any such column."""
    encoded = encoded.drop("text")
    shared = _sent(encoded.sparkSession, path)
    at, names = encoded.columns.index("ids"), [*encoded.columns, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.some(batches):
            out = _texts((raw.as_buffer() if raw.is_valid else b"" for raw in batch.column(at)), *shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names)

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("text", StringType())]))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encode(common.table(spark, sf_dir, "documents"), tokens.public("byte_bpe_50k.json"), decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
