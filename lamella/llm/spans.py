"""Spans of regular expressions in a text, by Spark's own functions.

Spark has no function for the places of matches. ``split`` gives what stands between them and ``regexp_extract_all`` the
matches themselves, so running sums of their lengths are the places. Patterns handed in here have to be possessive or
bounded wherever they repeat a group, so that Java neither backtracks nor recurses over a long text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN = "array<struct<start:int,end:int,text:string>>"
_WITH_CONTEXT = "array<struct<start:int,end:int,text:string,left:string,right:string>>"
_BLOCK, _CHUNK = 256, 4096
#: Characters that a match with context has at least.
_LEAST = 7


def scanned(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The running results of an associative ``merge`` over an array, each with its own element.

    An array can only grow by being copied, so elements are merged within blocks, and blocks by their last results: time is
    linear up to millions of elements.
    """

    def run(a: Column) -> Column:
        return F.aggregate(F.slice(a, F.lit(2), F.size(a)), F.slice(a, F.lit(1), F.lit(1)), lambda done, x: F.concat(done, F.array(merge(F.element_at(done, -1), x))))

    def whole(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")), lambda b: run(F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK))))
        after = lambda done, last: F.flatten(F.transform(done, lambda r, k: F.when(k == 0, r).otherwise(let(last[k - 1], lambda c: F.transform(r, lambda x: merge(c, x))))))
        return let(blocks, lambda done: let(run(F.transform(done, lambda r: F.element_at(r, -1))), lambda last: after(done, last)))

    return let(values, lambda a: F.when(F.size(a) == 0, a).when(F.size(a) <= _BLOCK, run(a)).otherwise(whole(a)))


def running(lengths: Column) -> Column:
    """Running sums of an array, each with its own element."""
    return scanned(lengths, lambda a, b: a + b)


def _context(gaps: Column, found: Column, size: int) -> Column:
    """(left, right) of each match: up to ``size`` characters before it, and the one after it.

    They are put together from the ends of the gaps and matches next to a match, so that no text is counted through again;
    matches have to be of ``_LEAST`` characters or more for that.
    """
    tail = lambda t: F.substring(F.coalesce(t, F.lit("")), -size, size)
    head = lambda t: F.substring(F.coalesce(t, F.lit("")), 1, 1)
    before = 2 * (size // _LEAST + 1)
    ends = F.flatten(F.zip_with(gaps, found, lambda g, m: F.array(tail(g), tail(m))))
    left = lambda e, i: tail(F.array_join(F.slice(e, F.greatest(F.lit(1), 2 * i + 1 - before), F.least(2 * i + 1, F.lit(before + 1))), ""))
    right = lambda i: F.substring(F.concat(head(F.get(gaps, i + 1)), head(F.get(found, i + 1))), 1, 1)
    return let(ends, lambda e: F.transform(found, lambda _, i: F.struct(left(e, i).alias("left"), right(i).alias("right"))))


def spans(text: Column, pattern: str, where: Column, group: int = 0, context: int = 0) -> Column:
    """The matches of ``pattern`` as (start, end, text), in code points, end exclusive; ``text`` of the match's ``group``.

    ``where`` is a cheap condition that each text with a match meets. With a ``context``, ``left`` holds as many characters
    before the match, and ``right`` the one after it.
    """

    def placed(found: Column, gaps: Column, shown: Column) -> Column:
        lengths = F.transform(found, F.length)
        ends = let(F.zip_with(gaps, lengths, lambda g, n: F.coalesce(F.length(g), F.lit(0)) + F.coalesce(n, F.lit(0))), running)
        more = [_context(gaps, found, context).alias("c")] if context else []
        fields = lambda x: [x["c"]["left"].alias("left"), x["c"]["right"].alias("right")] if context else []
        zipped = F.arrays_zip(F.slice(ends, F.lit(1), F.size(found)).alias("e"), lengths.alias("n"), shown.alias("t"), *more)
        return let(zipped, lambda z: F.transform(z, lambda x: F.struct((x["e"] - x["n"]).alias("start"), x["e"].alias("end"), x["t"].alias("text"), *fields(x))))

    shape = _WITH_CONTEXT if context else SPAN
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.split(text, pattern, -1).alias("gaps"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.lit(None).cast("array<string>")).alias("group"),
    )
    made = let(parts, lambda p: F.when(F.size(p["found"]) > 0, placed(p["found"], p["gaps"], p["group"] if group else p["found"])).otherwise(F.array().cast(shape)))
    return F.coalesce(F.when(where, made), F.array().cast(shape)).cast(shape)


def touched(some: Column, others: Column) -> Column:
    """For each of some spans, in their order, whether it overlaps any of the others.

    Bounds are sorted and counted: a span overlaps as many others as begin before its end, less those that end at or
    before its start.
    """
    event = lambda at, o, k, w: F.struct(at.alias("at"), F.lit(o).alias("o"), k.alias("k"), F.lit(w).cast("long").alias("w"))
    theirs = F.flatten(F.transform(others, lambda s: F.array(event(s["end"], 0, F.lit(-1), 1), event(s["start"], 2, F.lit(-1), 1 << 32))))
    own = lambda a: F.flatten(F.transform(a, lambda s, i: F.array(event(s["start"], 1, 2 * i, 0), event(s["end"], 1, 2 * i + 1, 0))))

    def counted(a: Column) -> Column:
        events = F.array_sort(F.concat(theirs, own(a)))
        seen = let(events, lambda e: F.zip_with(e, running(F.transform(e, lambda x: x["w"])), lambda x, n: F.struct(x["k"].alias("k"), n.alias("n"))))
        counts = F.transform(F.array_sort(F.filter(seen, lambda x: x["k"] >= 0)), lambda x: x["n"])
        return let(counts, lambda n: F.transform(a, lambda _, i: F.shiftright(n[2 * i + 1], 32) > n[2 * i].bitwiseAND(F.lit((1 << 32) - 1))))

    return let(some, lambda a: F.when((F.size(a) == 0) | (F.size(others) == 0), F.transform(a, lambda _: F.lit(False))).otherwise(counted(a)))


def apart(some: Column, others: Column) -> Column:
    """The spans that overlap none of the others, in their order."""
    return F.when(F.size(some) == 0, some).otherwise(let(touched(some, others), lambda hit: F.filter(some, lambda _, i: ~hit[i])))


def merged(sorted_spans: Column) -> Column:
    """Disjoint (start, end) that cover the same places as spans sorted by start."""

    def closed(z: Column, upto: Column) -> Column:
        fresh = F.filter(F.sequence(F.lit(0), F.size(z) - 1), lambda i: F.coalesce(z[i]["start"] > F.get(upto, i - 1), F.lit(True)))
        end = lambda own, k: F.coalesce(F.get(upto, F.get(own, k + 1) - 1), F.element_at(upto, -1))
        return let(fresh, lambda own: F.transform(own, lambda i, k: F.struct(z[i]["start"].alias("start"), end(own, k).alias("end"))))

    none_ = F.array().cast("array<struct<start:int,end:int>>")
    return let(sorted_spans, lambda z: F.when(F.size(z) == 0, none_).otherwise(let(scanned(F.transform(z, lambda s: s["end"]), F.greatest), lambda upto: closed(z, upto))))


def masked(text: Column, spans_: Column, mark: str) -> Column:
    """The text with each of the (disjoint, sorted) spans replaced by ``mark``.

    Finding a place in a text means counting through it, so the text is cut into short chunks once, and what stays is taken
    from the chunks.
    """

    def between(chunks: Column, a: Column, b: Column) -> Column:
        inner = lambda k: F.substring(chunks[k], F.greatest(a - k * _CHUNK, F.lit(0)) + 1, F.least(b, (k + 1) * _CHUNK) - F.greatest(a, k * _CHUNK))
        return F.when(a >= b, "").otherwise(F.array_join(F.transform(F.sequence(F.floor(a / _CHUNK).cast("int"), F.floor((b - 1) / _CHUNK).cast("int")), inner), ""))

    def pieces(own: Column, chunks: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), own["end"])
        starts = F.concat(own["start"], F.array(F.length(text)))
        return F.array_join(F.zip_with(ends, starts, lambda a, b: between(chunks, a, b)), mark)

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}+"), F.lit(0))
    return F.when(F.size(spans_) == 0, text).otherwise(let(spans_, lambda own: let(cut, lambda chunks: pieces(own, chunks))))


def listed(all_spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(all_spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kind(kind: str, own: Column) -> Column:
    return F.transform(own, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
