"""Language identification by error-correcting output codes.

Each learned language gets a binary codeword. For every bit a binary classifier over hashed byte n-grams (lengths 1 to
3 within lower-cased text) tells the languages whose bit is set from the others: its weights are smoothed log odds of
the n-gram counts of the two sides. The counts come from all labelled documents, summed per partition before anything is
moved. The sums over the languages of each side are taken in Spark, so that what reaches the driver is a number for each
bucket and bit and, for each language, its name and one number a bit; there is no greatest number of languages. A text's
margin for a bit is its mean log odds.
Decoding picks the codeword of the least loss, where a bit's loss is logistic in its margin, measured in units of the
margin that the language is expected to have, and weighted by how well the bit separates its two sides. Where the
runner-up's loss comes close, the prediction is flagged as ambiguous.

Edge cases: a null text, or one without a letter, gives ``und`` with score 0; with no labelled rows all texts are
``und``; with one learned language every text gets it, at score 1; a null doc_id is predicted but not learned from;
ties go to the first language by name; tables without rows give none; repeated rows are predicted alike; other columns
are ignored. Whole texts are read, whatever their length, and a long one in pieces, whose counts and margins add up.
"""

from __future__ import annotations

import codecs
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: n-gram hash buckets.
BUCKETS = 1 << 15
#: Added to each count before taking odds.
SMOOTHING = 0.5
#: Bytes of a text that are looked at together, language vectors that a task holds, and (document, language, bit) losses at once.
PIECE, VECTORS_HELD, LOSSES = 1 << 19, 64, 1 << 21
#: Shares and their products with weights are summed as integers of this unit, so that sums don't depend on their order.
UNIT = 1 << 40
#: Seed and least length of the codewords.
CODE_SEED, CODE_BITS = 11, 8
#: A prediction whose runner-up comes this close in probability is ambiguous.
AMBIGUOUS = 0.02
UNKNOWN = "und"


def grams(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Buckets of the 1-, 2- and 3-byte grams that end at each byte: three arrays of the length of ``data``.

    Each document counts as preceded by spaces, so that its grams don't depend on its neighbours.
    """
    b = data.astype(np.uint32)
    b1 = np.concatenate(([32], b[:-1])).astype(np.uint32)
    b1[starts] = 32
    b2 = np.concatenate(([32], b1[:-1])).astype(np.uint32)
    b2[starts] = 32
    two = b1 << np.uint32(8) | b | np.uint32(1 << 24)
    three = b2 << np.uint32(16) | b1 << np.uint32(8) | b
    squeeze = lambda x: ((x * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    return np.stack([b.astype(np.int64), squeeze(two), squeeze(three)])


def _lower(texts: pa.Array) -> Iterator[bytes | None]:
    for k in range(0, len(texts), 256):
        yield from pc.utf8_lower(texts.slice(k, 256).cast(pa.large_string())).cast(pa.large_binary()).to_pylist()


def _pieces(part: common.Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The buckets of a slice, one gram length or piece after the other, with the places at which its documents start.

    A slice is longer than ``PIECE`` only if it is one document; pieces of it are preceded by the two bytes before them.
    """
    if len(part.data) <= max(PIECE, common.SLICE_BYTES + 1) or part.n > 1:
        for g in grams(part.data, part.starts):
            yield g, part.starts
        return
    for k in range(0, len(part.data), PIECE):
        before = min(k, 2)
        for g in grams(part.data[k - before : k + PIECE], np.zeros(0 if k else 1, dtype=np.int64)):
            yield g[before:], np.zeros(1, dtype=np.int64)


def _letter_in(text: memoryview) -> bool:
    ascii_letter = bytes(range(65, 91)) + bytes(range(97, 123))
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    for k in range(0, len(text), 1 << 16):
        some = bytes(text[k : k + (1 << 16)])
        if len(some.translate(None, ascii_letter)) != len(some) or any(c.isalpha() for c in reader.decode(some)):
            return True
    return False


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts by language, a row for each bucket that a language has in the partition; seldom several."""
    held: dict[str, np.ndarray] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"])
        held.clear()

    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        order = np.argsort(langs, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], langs[order][1:] != langs[order][:-1], [True]))) if len(langs) else []
        for a, b in itertools.pairwise(edges):
            own = batch.column(0).take(pa.array(np.sort(order[a:b])))
            if langs[order[a]] not in held and len(held) >= VECTORS_HELD:
                yield from told()
            into = held.setdefault(langs[order[a]], np.zeros(BUCKETS, dtype=np.int64))
            for part in common.slices(_lower(own)):
                for g, _ in _pieces(part):
                    into += np.bincount(g, minlength=BUCKETS)
    yield from told()


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits
    expected: np.ndarray  # languages x bits, the margin that a text of the language is expected to have
    trust: np.ndarray  # bits


def codewords(n: int, bits: int | None = None) -> np.ndarray:
    """A codeword of +1 and -1 for each of ``n`` languages: up to 7 bits every split, beyond them a random code.

    For up to four languages these are all ways of splitting them in two (for four: three 2:2 and four 1:3 splits);
    beyond that, the random code with the largest least distance among 64 draws.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 4:
        return np.array([[1 if i == 0 or not (k >> (i - 1)) & 1 else -1 for k in range(1, 1 << (n - 1))] for i in range(n)], dtype=float)
    bits = bits or max(CODE_BITS, 4 * math.ceil(math.log2(n)))
    rng, best, found = np.random.default_rng(CODE_SEED), -1.0, None
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        if (np.abs(code.sum(0)) == n).any():
            continue
        least = ((bits - code @ code.T) / 2 + bits * np.eye(n)).min()
        if least > best:
            best, found = least, code
    return found


def fit(labelled: DataFrame) -> Model:
    """A model of all rows of (text, lang) with neither null; each language counts alike, however many documents it has."""
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    counts = common.stored(rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").toArrow()
    languages = totals.column("lang").to_pylist()
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((BUCKETS, 1)), np.zeros((0, 1)), np.ones(1))
    code = codewords(len(languages))
    size = totals.column("n").to_numpy() + SMOOTHING * BUCKETS
    bits = range(code.shape[1])
    known = pa.table([totals.column("lang"), pa.array(size), pa.array((code > 0).tolist(), pa.list_(pa.bool_()))], ["lang", "size", "code"])
    spark = labelled.sparkSession
    share = counts.join(spark.createDataFrame(known), "lang").withColumn("share", F.col("n") / F.col("size"))
    parts = lambda c: F.sum(F.round(c * UNIT).cast("long"))
    sums = share.groupBy("bucket").agg(parts(F.col("share")).alias("all"), *(parts(F.when(F.col("code")[k], F.col("share")).otherwise(0.0)).alias(f"on{k}") for k in bits)).toArrow()
    seen, on = np.zeros(BUCKETS), np.zeros((BUCKETS, len(bits)))
    at = sums.column("bucket").to_numpy()
    seen[at] = sums.column("all").to_numpy() / UNIT
    for k in bits:
        on[at, k] = sums.column(f"on{k}").to_numpy() / UNIT
    weights = weighed(code, size, seen, on)
    table = spark.createDataFrame(pa.table([pa.array(np.arange(BUCKETS)), pa.array(weights.tolist(), pa.list_(pa.float64()))], ["bucket", "w"]))
    told = share.join(table, "bucket").groupBy("lang").agg(*(parts(F.col("share") * F.col("w")[k]).alias(f"m{k}") for k in bits)).orderBy("lang").toArrow()
    expected = np.stack([told.column(f"m{k}").to_numpy() / UNIT for k in bits], axis=1) + SMOOTHING / size[:, None] * weights.sum(0)
    return finished(languages, code, weights, expected)


def weighed(code: np.ndarray, size: np.ndarray, seen: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Log odds by bucket and bit: the mean smoothed share of a bucket among the languages whose bit is set, over that of
    the others. ``size`` are smoothed totals by language, ``seen`` and ``on`` sums of shares over all and over those set."""
    weights = np.zeros(on.shape)
    for k in range(code.shape[1]):
        side = code[:, k] > 0
        if side.all():
            continue
        own = (on[:, k] + (SMOOTHING / size[side]).sum()) / side.sum()
        rest = (np.maximum(seen - on[:, k], 0.0) + (SMOOTHING / size[~side]).sum()) / (~side).sum()
        weights[:, k] = np.log(own) - np.log(rest)
    return weights


def finished(languages: list[str], code: np.ndarray, weights: np.ndarray, expected: np.ndarray) -> Model:
    trust = np.minimum(np.where(code > 0, expected, np.inf).min(0), np.where(code < 0, -expected, np.inf).min(0))
    trust = np.where(np.isfinite(trust), np.maximum(trust, 1e-3), 1.0)
    return Model(languages, code, weights.astype(np.float32), expected, trust / trust.sum())


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, whether it is ambiguous, and the codeword distance (weighted loss) of the winner."""
    n, bits = len(texts), model.code.shape[1]
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n), np.zeros(n, dtype=bool), np.zeros(n)
    margins, size, letters = np.zeros((n, bits)), np.zeros(n), np.zeros(n, dtype=bool)
    for part in common.slices(_lower(texts)):
        own = slice(part.first, part.first + part.n)
        raw = memoryview(part.data)
        letters[own] = [_letter_in(raw[s:e]) for s, e in zip(part.starts.tolist(), part.ends.tolist(), strict=True)]
        size[own] = 3 * (part.ends - part.starts + 1)
        for g, starts in _pieces(part):
            margins[own] += np.add.reduceat(model.weights[g], starts, axis=0, dtype=np.float64)
    margins /= np.maximum(size, 1)[:, None]
    best, loss, score, second = (np.zeros(n, dtype=t) for t in (np.int64, float, float, float))
    step = max(1, LOSSES // max(1, len(model.languages) * bits))
    for k in range(0, n, step):
        best[k : k + step], loss[k : k + step], score[k : k + step], second[k : k + step] = decoded(model, margins[k : k + step])
    lang = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
    return lang, np.where(letters, score, 0.0), letters & (score - second < AMBIGUOUS), np.where(letters, loss, 0.0)


def decoded(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The language of the least loss for each row of margins, its loss, its share of the odds, and the runner-up's."""
    unit = np.maximum(np.abs(model.expected), 1e-3)
    loss = np.logaddexp(0.0, -4.0 * margins[:, None, :] * (model.code / unit)[None, :, :]) @ model.trust
    odds = np.exp(-8.0 * (loss - loss.min(1, keepdims=True)))
    share = odds / odds.sum(1, keepdims=True)
    best, row = loss.argmin(1), np.arange(len(loss))
    second = np.partition(share, -2, axis=1)[:, -2] if len(model.languages) > 1 else np.zeros(len(loss))
    return best, loss[row, best], share[row, best], second


def fold() -> Column:
    """crc32 of doc_id as text, modulo 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def model_of(docs: DataFrame) -> Model:
    """Learned from the labelled documents outside the held-out fold."""
    slim = common.narrow(docs, "doc_id", "text", "lang")
    with common.scope():
        return fit(slim.where(fold() != 2).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous and loss of each document."""
    model = model or model_of(docs)
    slim = common.narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vector for each language and bit, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, unsure, loss = predict(shared.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure), pa.array(loss)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous", "loss"])

    return slim.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean, loss double")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language can be told: those neither ``und`` nor ambiguous. All columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model_of(docs))

    def verdict(texts: pa.Array) -> np.ndarray:
        lang, _, unsure, _ = predict(shared.value, texts)
        return (np.array(lang, dtype=object) != UNKNOWN) & ~unsure

    return common.kept_rows(docs, verdict)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))
