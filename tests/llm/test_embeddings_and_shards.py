"""Embedding near-duplicates and sharding against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lamella.llm import embedding_dedup, registry, sharding


def brute(rows):
    """(vec_id -> links, least id of the component) over rows of (vec_id, embedding, label)."""
    ok = [i for i, (_, e, g) in enumerate(rows) if g is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    links, head = Counter(), list(range(len(rows)))

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    for a in range(len(ok)):
        for b in range(a):
            i, j = ok[a], ok[b]
            if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], dtype=float), np.array(rows[j][1], dtype=float)
                if (x @ y) / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    head[top(i)] = top(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[top(i)].append(r[0])
    return [(r[0], links[i], min(least[top(i)])) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(6)
    rows = []
    for label in (0, 1):
        for _ in range(25):
            centre = rng.normal(size=12)
            rows += [((centre + rng.normal(size=12) * s).tolist(), label) for s in (0, 0, 0.1, 0.2, 0.3, 0.5)]
    same = rng.normal(size=12).tolist()
    rows += [(same, 1)] * 40 + [((np.array(same) * 2).tolist(), 1)] + [((np.array(same) + rng.normal(size=12) * 0.25).tolist(), 1) for _ in range(120)]
    rows += [(None, 1), ([], 1), ([0.0] * 12, 1), ([math.nan] * 12, 1), ([math.inf] + [1.0] * 11, 0), ([None] + [1.0] * 11, 0), (same, None), (same[:5], 1), (same[:5], 1), ([1e-30] * 12, 0), ([1e30] * 12, 0)]
    order = rng.permutation(len(rows))
    return [(int(k), *rows[i]) for k, i in enumerate(order)]


SHAPE = "vec_id long, embedding array<float>, label int, LABEL string, rid int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SHAPE)


def test_links_against_all_pairs(spark, vectors, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    got = [(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.links(frame(spark, vectors)).collect()]
    single = [(i, [np.float32(x).item() if x is not None else None for x in e] if e else e, g) for i, e, g in vectors]
    assert sorted(got) == sorted(brute(single))


def test_kept_and_small_tables(spark):
    rows = [(5, [1.0, 0.0], 1), (3, [1.0, 0.01], 1), (3, [1.0, 0.01], 1), (None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (9, [1.0, 0.0], 2)]
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.links(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(False, 5, 3, 3, False), (False, 3, 3, 3, True), (False, 3, 3, 3, True), (True, 0, 3, 3, False), (True, 0, 0, None, True), (False, 9, 0, 9, True)], key=str)
    assert embedding_dedup.links(frame(spark, [])).count() == 0
    assert [tuple(r) for r in embedding_dedup.links(frame(spark, [(1, None, None)])).collect()] == [(1, 0, 1, True)]


def test_distant_blocks_are_skipped(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(12)[:6]
    rows = [(k, (centres[k % 6] + rng.normal(size=12) * 0.01).tolist(), 0) for k in range(3_000)]
    seen = []
    whole = embedding_dedup.block_pairs

    def counted(blocks):
        pairs = whole(blocks)
        seen.append((blocks.count(), pairs.count()))
        return pairs

    embedding_dedup.block_pairs = counted
    try:
        got = embedding_dedup.links(frame(spark, rows)).groupBy("component_id").count().collect()
    finally:
        embedding_dedup.block_pairs = whole
    assert sorted(r["count"] for r in got) == [500] * 6
    blocks, pairs = seen[0]
    assert pairs < blocks * (blocks + 1) / 2 / 2


def test_embedding_query(spark, small):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = [(r.vec_id, r.n_links, r.component_id) for r in registry.queries()["op4_embedding_dedup"](spark, small).collect()]
    assert sorted(got) == sorted(brute(rows))


def check_shards(rows, texts, shards=40):
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows"
        assert r.grown_shard is None
    assert set(slots) <= set(range(shards))
    count = [len(slots[k]) for k in range(shards)]
    assert max(count) - min(count) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards(docs):
    big = "the hot text"
    texts = [(k, f"text {k % 150}") for k in range(600)] + [(1000 + k, big) for k in range(400)] + [(5000, None), (5001, ""), (None, "x"), (None, "x"), (7, "é"), (7, "é")]
    rows = sharding.shard(docs(texts)).collect()
    check_shards(rows, texts)
    sizes = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert sizes == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)


def cut(where):
    """Links between equal texts that lie in different shards, from (text, shard) pairs."""
    held = defaultdict(Counter)
    for text, at in where:
        held[text][at] += 1
    return sum((c.total() ** 2 - sum(n * n for n in c.values())) // 2 for c in held.values())


def test_groups_come_together(spark, docs):
    texts = [(k, f"text {k % 900}") for k in range(3_600)] + [(10_000 + k, "the hot text") for k in range(2_400)] + [(20_000 + k, f"lone {k}") for k in range(2_000)]
    table = docs(texts)
    rows = sharding.shard(table).collect()
    check_shards(rows, texts)
    ended = [(r.text_crc32, r.shard) for r in rows]
    start = [(r.text_crc32, r.start) for r in sharding.labelled(table)[0].collect()]
    small = lambda pairs: [p for p in pairs if p[0] != zlib.crc32(b"the hot text")]
    assert cut(small(ended)) < 0.1 * cut(small(start))
    hot = Counter(s for t, s in ended if t == zlib.crc32(b"the hot text"))
    assert len(hot) <= 26  # it fills twelve shards, and asks for twice as many
    assert cut(ended) < cut(start)


def test_labels_decide(docs):
    """Only what a shard has beyond its quota is elsewhere than its label says."""
    texts = [(k, f"text {k % 700}") for k in range(2_000)] + [(20_000 + k, f"lone {k}") for k in range(1_500)]
    _, cells, total = sharding.labelled(docs(texts))
    cells = cells.collect()
    load = Counter()
    for c in cells:
        load[c.shard] += c.n
    surplus = sum(max(0, n - ((s + 1) * total // 40 - s * total // 40)) for s, n in load.items())
    label = {(c.g, c.start, c.piece): c.shard for c in cells}
    rows, _, _ = sharding.labelled(docs(texts))
    by_doc = {r.doc_id: label[r.g, r.start, r.piece] for r in rows.collect()}
    moved = [r.doc_id for r in sharding.shard(docs(texts)).collect() if r.shard != by_doc[r.doc_id]]
    assert len(moved) == surplus
    assert sum(k < 20_000 for k in moved) <= surplus // 10


def test_hot_cells_are_spread(docs):
    texts = [(None if k % 2 else 7, "the hot text") for k in range(3_000)]
    rows, cells, _ = sharding.labelled(docs(texts))
    assert max(r["count"] for r in rows.groupBy("g", "start", "piece").count().collect()) < 30
    check_shards(sharding.shard(docs(texts)).collect(), texts)


@pytest.mark.parametrize("n", [0, 1, 39, 41])
def test_few_documents(docs, n):
    texts = [(k, f"t{k}") for k in range(n)]
    check_shards(sharding.shard(docs(texts)).collect(), texts)


def test_shard_query(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = registry.queries()["op5_sharding"](spark, small).collect()
    check_shards(rows, texts)
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def test_propagation_keeps_to_quotas(spark):
    cells = spark.createDataFrame([(g, (g + s * 3) % 8, s, 1) for g in range(400) for s in range(6)], "g long, start int, piece int, n long")
    for total, most in ((2_400, 4.0), (4_000, 1.5)):  # all documents are linked, or some are not
        ended = sharding.propagate(cells, total, 8)
        held = ended.groupBy("g").agg({"shard": "collect_set"}).collect()
        load = {r.shard: r["sum(n)"] for r in ended.groupBy("shard").sum("n").collect()}
        assert np.mean([len(r[1]) for r in held]) < most  # nearly six at first
        assert max(load.values()) <= total // 8
        assert ended.agg({"n": "sum"}).first()[0] == 2_400


def test_a_group_moves_to_its_fullest_shard(spark):
    cells = spark.createDataFrame([(1, 3, 0, 5), (1, 8, 0, 2), (1, 9, 0, 1), (2, 4, 0, 1), (2, 5, 0, 2), (3, 3, 0, 1)], "g long, start int, piece int, n long")
    ended = {(r.g, r.start): r.shard for r in sharding.propagate(cells, 4_000, 40).collect()}
    assert ended == {(1, 3): 3, (1, 8): 3, (1, 9): 3, (2, 4): 5, (2, 5): 5, (3, 3): 3}
    full = {(r.g, r.start): r.shard for r in sharding.propagate(cells, 7 * 40, 40).collect()}  # shard 3 has room for one
    assert full[1, 3] == 3
    assert sum(n for (g, s), n in {(1, 3): 5, (1, 8): 2, (1, 9): 1, (3, 3): 1}.items() if full[g, s] == 3) <= 7
