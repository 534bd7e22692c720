"""Quality rules as a bitmask ledger.

``ledger`` measures every text once and stores, next to the measurements, one failure bit for each rule.
Policies are named, versioned masks over those bits: applying another one, or asking what a rule removes on its
own, reads only the ledger. ``ablations`` counts the distinct bit patterns once (there are at most ``2**len(RULES)``)
and derives from them what each rule fails, fails alone, and what would stay without it.

Edge cases: a null or blank text has no words, measures 0 everywhere and fails the length rule; a table without
rows gives a ledger without rows; equal rows give equal ledger rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

_SYMBOLS = np.zeros(256, dtype=np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars_all", "n_letters")
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

#: name -> whether a document fails; the position gives the bit. ``m`` maps each measurement to a Spark column.
RULES: dict[str, Callable[[dict], Any]] = {
    "too_short": lambda m: m["n_words"] < 50,
    "repeated_windows": lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 50,
    "symbols": lambda m: m["n_symbols"] * 100 > m["n_words"] * 25,
    "repeated_lines": lambda m: (m["n_lines"] >= 4) & (m["n_dup_lines"] * 100 > m["n_lines"] * 40),
    "word_length": lambda m: (m["word_chars"] > m["n_words"] * 20) | (m["word_chars"] < m["n_words"] * 2),
    "few_letters": lambda m: m["n_letters"] * 100 < m["word_chars"] * 30,
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}

#: Versioned policies: a document is kept if none of the policy's bits is set.
POLICIES: dict[str, int] = {
    "base-1": BIT["too_short"] | BIT["repeated_windows"],
    "web-1": sum(BIT.values()) - BIT["repeated_lines"],
    "web-2": sum(BIT.values()),
}
CURRENT = "web-2"


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of whole texts, by NumPy over their bytes."""
    out = {m: np.zeros(len(texts), dtype=np.int64) for m in MEASURES}
    for part in common.slices(texts):
        if part.n == 1 and len(part.data) > common.SLICE_BYTES + 1:
            for m, value in _measure_long(part.data[:-1]).items():
                out[m][part.first] = value
            continue
        own = slice(part.first, part.first + part.n)
        data, n = part.data, part.n
        start, end, doc = part.words()
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        out["n_words"][own] = np.bincount(doc, minlength=n)
        out["word_chars"][own] = np.bincount(doc, weights=points[end] - points[start], minlength=n).astype(np.int64)
        out["n_chars_all"][own] = points[part.ends] - points[part.starts]
        symbols = np.concatenate(([0], np.cumsum(_SYMBOLS[data])))
        out["n_symbols"][own] = symbols[part.ends] - symbols[part.starts]
        letters = np.concatenate(([0], np.cumsum(_letters(data))))
        out["n_letters"][own] = letters[part.ends] - letters[part.starts]
        if not len(start):
            continue
        # Lines: each holds the words between two line ends of one document.
        breaks = np.flatnonzero(data == 10)
        line_start = np.union1d(part.starts, breaks + 1)
        line_start = line_start[line_start < len(data)]
        line_doc = np.searchsorted(part.starts, line_start, side="right") - 1
        line_end = np.minimum(np.append(line_start[1:] - 1, len(data) - 1), part.ends[line_doc])
        word_at = np.searchsorted(line_start, start, side="right") - 1
        filled = np.unique(word_at)
        lines, of = part.hashes(line_start[filled], line_end[filled]), line_doc[filled]
        out["n_lines"][own] = np.bincount(of, minlength=n)
        order = np.lexsort((lines, of))
        again = (lines[order][1:] == lines[order][:-1]) & (of[order][1:] == of[order][:-1])
        out["n_dup_lines"][own] = np.bincount(of[order][1:][again], minlength=n)
        out["n_repeat_words"][own] = np.bincount(doc[_repeated(part.hashes(start, end), doc)], minlength=n)
    return out


def _letters(data: np.ndarray) -> np.ndarray:
    return ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 0xC0)


def _repeated(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each word is in a window of three words that its document holds twice or more."""
    covered = np.zeros(len(word), dtype=bool)
    at = common.runs(doc, 3)
    if len(at):
        window = common.window_hashes(word, at, 3)
        order = np.lexsort((window, doc[at]))
        same = (window[order][1:] == window[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    return covered


def _seconds(ordered: np.ndarray) -> np.ndarray:
    """Where, after the first, a sorted array holds a value for the second time."""
    same = ordered[1:] == ordered[:-1]
    again = np.concatenate(([False], same[:-1])) if len(same) else same
    return same & ~again


def _repeats(word: np.ndarray, step: int = 1 << 18) -> int:
    """The number of words of one document that are in a window held twice or more, with little room beside the windows."""
    n = max(len(word) - 2, 0)
    window = np.zeros(n, dtype=np.uint64)
    for k in range(0, n, step):
        window[k : k + step] = common.window_hashes(word[k : k + step + 2], np.arange(min(step, n - k)), 3)
    ordered = np.sort(window)
    twice = ordered[1:][_seconds(ordered)]
    del ordered
    covered = np.zeros(len(word), dtype=bool)
    for k in range(0, n if len(twice) else 0, step):
        own = window[k : k + step]
        hit = k + np.flatnonzero(twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own)
        for i in range(3):
            covered[hit + i] = True
    return int(covered.sum())


def _measure_long(data: np.ndarray) -> dict[str, int]:
    """The same of one long text, piece by piece; what is held besides is a hash for each word and line.

    Pieces end behind a separator, so that no word is cut; a line's hash is carried on from piece to piece.
    """
    out = dict.fromkeys(MEASURES, 0)
    words, lines = [], []
    carried, length, filled = 0, 0, False  # of the line that is open: its polynomial, its bytes, whether it holds a word
    begin = 0
    while begin < len(data):
        end = common.cut_after(data, begin, begin + common.SLICE_BYTES)
        part = common.Slice(0, [data[begin:end].tobytes()])
        raw, begin = part.data[:-1], end
        start, stop, _ = part.words()
        point = (raw & 0xC0) != 0x80
        before = np.concatenate(([0], np.cumsum(point, dtype=np.int32)))
        out["n_words"] += len(start)
        out["word_chars"] += int((before[stop] - before[start]).sum())
        out["n_chars_all"] += int(before[-1])
        out["n_symbols"] += int(_SYMBOLS[raw].sum())
        out["n_letters"] += int(_letters(raw).sum())
        words.append(part.hashes(start, stop))
        edge = np.concatenate(([0], np.flatnonzero(raw == 10) + 1))
        own_end = np.append(edge[1:] - 1, len(raw))
        poly = part.polynomials(edge, own_end)
        held = np.zeros(len(edge), dtype=bool)
        held[np.searchsorted(edge, start, side="right") - 1] = True
        first = (carried + pow(common.BASE, length, 1 << 64) * int(poly[0])) & ((1 << 64) - 1) if length else int(poly[0])
        poly[0], size = np.uint64(first), own_end - edge
        size[0] += length
        held[0] |= filled
        lines.append(common.mix(poly[:-1] + size[:-1].astype(np.uint64))[held[:-1]])
        carried, length, filled = int(poly[-1]), int(size[-1]), bool(held[-1])
    if filled:
        lines.append(common.mix(np.array([carried], dtype=np.uint64) + np.uint64(length)))
    line = np.sort(np.concatenate([*lines, np.zeros(0, dtype=np.uint64)]))
    out["n_lines"], out["n_dup_lines"] = len(line), int((line[1:] == line[:-1]).sum())
    held = np.concatenate([*words, np.zeros(0, dtype=np.uint64)])
    words.clear()
    out["n_repeat_words"] = _repeats(held)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = measure(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[m]) for m in MEASURES)], ["doc_id", *MEASURES])


def failure_bits() -> Column:
    columns = {m: F.col(m) for m in MEASURES}
    return reduce(Column.bitwiseOR, (F.when(rule(columns), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()))


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measurements and ``failed``, the bits of the rules that it fails."""
    slim = common.narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_measured, SCHEMA).withColumn("failed", failure_bits())


def passes(policy: str = CURRENT) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that would stay without it."""
    mask = POLICIES[policy]
    own = [F.struct(F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for r, b in BIT.items() if b & mask]
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    each = patterns.select("bits", "n", F.explode(F.array(*own)).alias("r")).select("bits", "n", "r.rule", "r.bit")
    counted = {"n_failed": F.col("bits").bitwiseAND(F.col("bit")) != 0, "n_failed_alone": F.col("bits") == F.col("bit"), "n_kept_without": F.col("bits").isin(0) | (F.col("bits") == F.col("bit"))}
    return each.groupBy("rule").agg(*(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long").alias(k) for k, c in counted.items()))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(common.table(spark, sf_dir, "documents"))
    failed = F.col("failed").bitwiseAND(F.lit(POLICIES["base-1"]).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), passes().alias("kept"), F.col("failed").alias("failure_bits"))


def oracle() -> str:
    """op9 as DuckDB SQL."""
    conditions = {
        "too_short": "n_words < 50", "repeated_windows": "n_repeat_words * 100 > n_words * 50", "symbols": "n_symbols * 100 > n_words * 25",
        "repeated_lines": "n_lines >= 4 AND n_dup_lines * 100 > n_lines * 40", "word_length": "word_chars > n_words * 20 OR word_chars < n_words * 2", "few_letters": "n_letters * 100 < word_chars * 30",
    }
    bits = " + ".join(f"CASE WHEN {conditions[name]} THEN {bit} ELSE 0 END" for name, bit in BIT.items())
    word = r"[^\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM (SELECT k, regexp_extract_all(t, '{word}+') AS words FROM d)),
g AS (SELECT k, w, i, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS g FROM w WINDOW p AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, w, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY k, g) > 1 THEN 1 ELSE 0 END AS r FROM g),
c AS (SELECT k, w, max(r) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM r),
m AS (SELECT k, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars, CAST(sum(c) AS BIGINT) AS n_repeat_words FROM c GROUP BY 1),
l AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{word}') GROUP BY 1),
a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  length(regexp_replace(t, '[^A-Za-z\x{{80}}-\x{{10FFFF}}]', '', 'g')) AS n_letters FROM d LEFT JOIN m USING (k) LEFT JOIN l USING (k)),
b AS (SELECT *, CAST({bits} AS BIGINT) AS failure_bits FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failure_bits & {POLICIES["base-1"]}) <> 0 AS base_failed, (failure_bits & {POLICIES[CURRENT]}) = 0 AS kept, failure_bits FROM b"""


def keep(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` whose text passes a policy, with all their columns: ledger rows, with the same bits and masks,
    that carry the documents along, so that no join by an id, which may be null or repeat, is needed."""
    own = docs.columns
    names = [f"_{i}" for i in range(len(own))]
    flat, at = docs.toDF(*names), own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[m]) for m in MEASURES)], [*names, *MEASURES])

    shape = StructType([*flat.schema.fields, *(StructField(m, LongType()) for m in MEASURES)])
    rows = flat.mapInArrow(run, shape).withColumn("failed", failure_bits())
    return rows.where(passes(policy)).select(*names).toDF(*own)
