import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamella.operators import encoding, pages
from lamella.operators.encoding import DIFFERENTIAL, LOCAL, PLAIN, Writer
from lamella.operators.table import Table


def walked(pages_):
    writer = Writer()
    return [writer.encode(p) for p in pages_]


def kinds(pages_):
    return [r["encoding"] for r in walked(pages_)]


def decoded(rows):
    out, entries = [], []
    for r in rows:
        if r["encoding"] == PLAIN:
            out.append(r["vals"])
            continue
        if r["encoding"] == LOCAL:
            entries = []
        assert r["base"] == len(entries)
        entries = entries + r["segment"]
        out.append([entries[c] for c in r["codes"]])
    return out


def test_shapes():
    few = ["a", "b", "c"] * 20
    assert kinds([[str(k) for k in range(100)]] * 2) == [PLAIN, PLAIN]
    assert kinds([[str(k % 80) for k in range(100)]]) == [LOCAL]
    assert kinds([["x"] * 50, ["x"] * 50]) == [LOCAL, DIFFERENTIAL]
    assert kinds([few, few, [*few, "d"]]) == [LOCAL, DIFFERENTIAL, DIFFERENTIAL]
    assert kinds([[f"{p}-{k % 40}" for k in range(100)] for p in range(3)]) == [LOCAL] * 3
    assert kinds([few, [str(k) for k in range(60)], few]) == [LOCAL, PLAIN, LOCAL]
    assert walked([few, few])[1]["segment"] == []
    assert walked([few, few])[1]["min_new"] == " "


def test_budget(monkeypatch):
    monkeypatch.setattr(encoding, "BUDGET", 100)
    long = [c * 60 for c in "ab"] * 5
    assert kinds([long, long, [*long, "c"]]) == [LOCAL, LOCAL, LOCAL]


def test_width_boundary_weighs_both_sides():
    wide = [f"{k:04d}" for k in range(250)] * 2
    small = [f"{k:04d}" for k in range(200)] * 2 + [f"n{k}" for k in range(10)] * 2
    writer = Writer()
    writer.encode(wide)
    distinct = sorted(set(small))
    new = [v for v in distinct if v not in writer.codes]
    assert (writer.gain(len(small), distinct, new) > 0) == (writer.choose(len(small), distinct, new) == LOCAL)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", "a", "b", "é", "Z", "a ", "x" * 300, "1", "2", "3"]), min_size=1, max_size=40), min_size=1, max_size=8))
def test_roundtrip(pages_):
    assert decoded(walked(pages_)) == pages_


def test_serialized_size():
    assert encoding.serialized([]) == 1
    assert encoding.serialized(["a", "é"]) == 1 + 2 + 3
    assert encoding.serialized(["x" * 128]) == 1 + 2 + 128


def test_frame_roundtrip_and_filter(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["", "é", "b"]), str(rng.randrange(k // 64 + 3)), str(k)) for k in range(500)]
    table = Table(spark.createDataFrame(rows, "rid long, a string, b string, u string"), page_size=64)
    coded = encoding.encode(table, run_pages=3).cache()
    assert {r.encoding for r in coded.select("encoding").distinct().collect()} == {PLAIN, LOCAL, DIFFERENTIAL}
    got = sorted((r.column, r.rid, r.v) for r in encoding.decode(coded, 64).collect())
    assert got == sorted((c, r[0], r[k]) for r in rows for k, c in enumerate("abu", 1))
    for column, k, value in (("a", 1, ""), ("b", 2, "3"), ("u", 3, "77"), ("b", 2, "none")):
        found = sorted(r.rid for r in encoding.filter_codes(coded, column, value, 64).collect())
        assert found == [r[0] for r in rows if r[k] == value]
    in_order = coded.where("column = 'b'").orderBy("page").collect()
    for first in range(0, 8, 3):
        assert [r.encoding for r in in_order[first : first + 3]] == kinds([[r[2] for r in rows[p * 64 : p * 64 + 64]] for p in range(first, min(first + 3, 8))])


def test_empty_table(spark):
    table = Table(spark.createDataFrame([], "rid long, a string"), page_size=64)
    assert encoding.encode(table).count() == 0
    assert pages.stats(table, "a").count() == 0
    assert pages.growing_codes(table, "a").count() == 0


@pytest.mark.parametrize("n", [0, 127, 128, 16_383, 16_384, 2**21, 2**62])
def test_varint(n):
    size, left = 1, n >> 7
    while left:
        size, left = size + 1, left >> 7
    assert encoding.varint(n) == size
