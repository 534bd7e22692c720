"""Near-duplicates against all pairs, in documents made to be near the limit."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamella.llm import common, graph, near_dedup, registry

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall(text or "")
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else None


def alike(x, y):
    both = (x & y).total()
    return both >= 0.8 * (x.total() + y.total() - both)


def brute(rows):
    """doc_id -> least doc_id of its group, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    head, totals = {i: i for i in sets}, {i: s.total() for i, s in sets.items() if s}

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for a, b in combinations(sorted(i for i in sets if sets[i]), 2):
        if 0.8 * max(totals[a], totals[b]) <= min(totals[a], totals[b]) and alike(sets[a], sets[b]):
            x, y = sorted((top(a), top(b)))
            head[y] = x
    return {i: top(i) for i in sets}


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]


def edited(rng, base, share):
    out = list(base)
    for k in rng.sample(range(len(out)), max(1, int(share * len(out)))):
        out[k] = "".join(rng.choices("abcdefgh", k=5))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    rows = []
    for n in (6, 30, 120, 400):
        for share in (0.005, 0.02, 0.03, 0.05, 0.2):
            base = words(rng, n)
            rows += [" ".join(base), " ".join(base), *(" ".join(edited(rng, base, share)) for _ in range(6))]
    shared = words(rng, 40)
    rows += [" ".join(words(rng, 30) + shared) for _ in range(60)]  # a common passage alone links nothing
    many = words(rng, 150)
    rows += [" ".join(edited(rng, many, 0.02)) for _ in range(150)]  # a large group, some pairs of which are apart
    chain = words(rng, 100)
    for _ in range(12):  # each alike to the next only
        chain = chain[2:] + words(rng, 2)
        rows.append(" ".join(chain))
    rows += ["", None, " \n", "one", "one", "two words", "two  words\n", "words two", "x" * 100_000, "x" * 100_000, "a b c d e " * 20_000, "a b c d e " * 20_001]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_groups_against_all_pairs(docs, corpus):
    got = {r.d: r.head.d for r in near_dedup.groups(docs(corpus)).collect()}
    assert got == brute(corpus)


def test_keep_leaves_one_of_each_group(docs, corpus):
    table = docs(corpus)
    kept = near_dedup.keep(table)
    assert kept.columns == table.columns
    assert sorted(r[0] for r in kept.collect()) == sorted(i for i, g in brute(corpus).items() if i == g)


def test_repeated_rows_keep_one(docs):
    text = "these are more than five words in all"
    rows = near_dedup.groups(docs([(1, text), (1, text), (1, text), (None, "a"), (None, "a"), (2, None)])).collect()
    assert sorted((r.d, r.rid == r.head.rid) for r in rows) == sorted([(1, True), (1, False), (1, False), (near_dedup._NO_ID, True), (near_dedup._NO_ID, False), (2, True)])


def test_multiplicity_counts(docs):
    rng = random.Random(5)
    base, chorus = words(rng, 60), words(rng, 30)
    rows = [" ".join(base + chorus * n) for n in (1, 2, 2, 12, 13)]  # as sets, all are alike
    assert {r.d: r.head.d for r in near_dedup.groups(docs(rows)).collect()} == brute(list(enumerate(rows))) == {0: 0, 1: 1, 2: 1, 3: 3, 4: 3}


def test_large_buckets_meet_by_rare_shingles(docs, corpus, monkeypatch):
    monkeypatch.setattr(near_dedup, "LARGE", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_ELEMENTS", 3_000)
    assert {r.d: r.head.d for r in near_dedup.groups(docs(corpus)).collect()} == brute(corpus)


def test_a_bucket_of_many_unlike_members(spark, monkeypatch):
    """50,000 documents with a common passage, which all share buckets, and a few alike among them."""
    rng = random.Random(12)
    passage = words(rng, 45)
    texts = [" ".join(passage + words(rng, 20)) for _ in range(50_000)]
    for k in range(0, 1_000, 100):
        texts[k + 1] = texts[k] + " more"
    compared = []
    whole = near_dedup._across
    monkeypatch.setattr(near_dedup, "_across", lambda met, root, sets: compared.append(met.groupBy("bucket").count().agg({"count": "max"}).first()[0]) or whole(met, root, sets))
    rows = near_dedup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8))
    heads = {r.d: r.head.d for r in rows.collect()}
    assert compared[0] > 10_000
    assert heads == {k: k - 1 if k % 100 == 1 and k < 1_000 else k for k in range(50_000)}


def test_small_cases(docs):
    text = "these are more than five words in all"
    assert near_dedup.keep(docs([])).count() == 0
    assert near_dedup.groups(docs([])).count() == 0
    assert [r[0] for r in near_dedup.keep(docs([(1, text), (1, text), (1, text)])).collect()] == [1]
    rows = near_dedup.keep(docs([(None, text), (None, text), (None, "something else of five words"), (7, "something else of five words"), (None, None), (3, None)])).collect()
    assert sorted((r[0] is None, r[0], r[1]) for r in rows if r[0] is not None) == [(False, 3, None), (False, 7, "something else of five words")]
    assert sorted(str(r[1]) for r in rows if r[0] is None) == ["None", text]
    assert near_dedup.keep(docs([(k, "") for k in range(5)])).count() == 5


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = registry.queries()["op7_near_dedup"](spark, small).collect()
    wanted = brute(rows)
    assert {r.doc_id: r.class_id for r in got} == wanted
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert all(r.class_size == list(wanted.values()).count(r.class_id) for r in got)


@pytest.mark.parametrize("n", [1, 3, 40, 3_000])
@pytest.mark.parametrize("similarity", [0.3, 0.8])
def test_coordinates_agree_as_often_as_sets_are_alike(n, similarity):
    rng = np.random.default_rng(n)
    found, true, k = [], [], 280
    for _ in range(30):
        both = int(round(2 * n * similarity / (1 + similarity)))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate((a[:both], rng.integers(0, 1 << 63, n - both, dtype=np.uint64)))
        sig = near_dedup.signatures(np.concatenate((a, b)), np.repeat([0, 1], n), 2, k)
        assert (sig != near_dedup._EMPTY).all()
        found.append((sig[0] == sig[1]).mean())
        true.append(both / (2 * n - both))
    assert abs(np.mean(found) - np.mean(true)) < 4 * 0.5 / np.sqrt(30 * k) + 0.01


def test_weighted_coordinates():
    rng = np.random.default_rng(4)
    found, true = [], []
    for _ in range(30):
        h = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
        v, w = rng.random(50) * 3, rng.random(50) * 3
        sig = near_dedup.signatures(np.concatenate((h, h)), np.repeat([0, 1], 50), 2, weight=np.concatenate((v, w)))
        found.append((sig[0] == sig[1]).mean())
        true.append(np.minimum(v, w).sum() / np.maximum(v, w).sum())
    assert abs(np.mean(found) - np.mean(true)) < 0.03


def test_whole_weights_are_repeated_elements_and_cut_in_portions():
    rng = np.random.default_rng(3)
    layers, ranks = rng.integers(1, 9, 50), rng.integers(1, 30, 50)
    layers[7] = 5_000
    parts = list(near_dedup._portions(layers, ranks, 200))
    assert max(int(ranks[e].sum()) for e, _ in parts) < 200 + 60
    pairs = [(int(e), int(j)) for part in parts for e, j in zip(*part, strict=True)]
    assert pairs == [(e, j) for e in range(50) for j in range(layers[e])]
    h, w = rng.integers(0, 1 << 63, 50, dtype=np.uint64), layers.astype(float)
    zero = np.zeros(50, dtype=np.int64)
    assert (near_dedup.signatures(h, zero, 1, weight=w) == near_dedup.signatures(np.append(h, h[:1]), np.append(zero, 0), 1, weight=np.append(w, 1e-12))).mean() > 0.99


def test_a_signature_depends_on_its_set_alone():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    doc = np.repeat([0, 1, 2], [5, 95, 800])
    together = near_dedup.signatures(h, doc, 3)
    for d in range(3):
        assert (near_dedup.signatures(h[doc == d], np.zeros((doc == d).sum(), dtype=np.int64), 1)[0] == together[d]).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t", max_size=30), min_size=1, max_size=8))
def test_shingles(texts):
    for part in common.slices(texts):
        h, d, times = near_dedup.shingles(part)
        assert [int((d == k).sum()) for k in range(part.n)] == [len(shingles(t) or ()) for t in texts]
        ours = [tuple(near_dedup.elements(h[d == k], times[d == k]).tolist()) for k in range(part.n)]
        assert [len(set(o)) for o in ours] == [(shingles(t) or Counter()).total() for t in texts]
        for i, j in combinations(range(part.n), 2):
            assert (ours[i] == ours[j]) == (shingles(texts[i]) == shingles(texts[j]))


def test_blocks_count_common_elements():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[: int(f * 20_000)], rng.integers(0, 1 << 63, 500, dtype=np.uint64)))) for f in (1, 0.95, 0.9, 0.8, 0.5)]
    wanted = [[len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)) for y in sets] for x in sets]
    assert near_dedup._similar(sets, sets).tolist() == wanted


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    head = {n: n for e in edges for n in e}
    for _ in head:
        for a, b in edges:
            head[a] = head[b] = min(head[a], head[b])
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: head[n] for n in linked}


def test_a_long_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 500)]
    random.Random(1).shuffle(edges)
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in got.groupBy("root").count().collect()} == {(0, 301), (1000, 500)}
