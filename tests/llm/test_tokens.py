"""Packing and the codec against the tokenizers library itself."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamella.llm import codec, packing, registry, tokens

FILES = {n: tokens.public(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}
ODD = [
    None, "", " ", "\n", " \n ", "a", " a", "a ", "don't 'Stop' we're", "x y   z", "tab\tand\r\nline", "a\n\n b", "<|endoftext|>", "x<|endoftext|> y <|endoftext|>", "<|startoftext|>", "~ ~~ a~b", "日本語のテキスト", "ΑΣ ΣΑΣ", "İstanbul ŉ µ ª",
    "é ́x", "12345 6,7", "\x00 \x01", "\x00a\x01\x02", " x", "😀 😀😀", "a" * 20_000, "word " * 20_000, "é×µ¿", "ﬁ ﬂ", "\x85 \x85",
]
ALPHABET = ["a", "B", "é", "Ñ", " ", "  ", "\n", "\t", "'s", "'re", "1", "23", ",", ".", "!!", "|", "~", "×", "µ", "¿", " ", "́", "Σ", "İ", "日", "<|endoftext|>", "<|", "\x00", "\x85", "😀", "-"]


def reference(name, text):
    return tokens.load(FILES[name]).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_words_make_the_texts_ids(name):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices(ALPHABET, k=rng.randrange(25))) for _ in range(5_000)]
    got = tokens.WordCache(FILES[name]).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [reference(name, t) for t in texts]
    own = tokens.load(FILES[name])
    for t, g in zip(texts, got, strict=True):
        if t:
            assert b"".join(tokens.encode_words(own, tokens.split(t))) == g


def test_a_full_cache_starts_afresh(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 10)
    cache = tokens.WordCache(FILES["word_bpe_49k.json"])
    for k in range(20):
        text = " ".join(f"w{k}{c}" for c in "abcdef") + " " + "long" * 30
        assert np.frombuffer(cache.encode([text])[0], "<u4").tolist() == reference("word_bpe_49k.json", text)
    assert len(cache.known) <= 10
    assert not any(len(w) > tokens.LONGEST_CACHED for w in cache.known)


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 3 * 4096, 10_000])
def test_lengths(n):
    got = packing.lengths(n)
    assert sum(got) == n
    assert got == sorted(got, reverse=True)
    assert all(x & (x - 1) == 0 and x <= 4096 for x in got)
    assert len({x for x in got if x < 4096}) == len([x for x in got if x < 4096])


def check_packed(rows, texts):
    seen, of = {}, {}
    for r in rows:
        raw = np.array(of.setdefault(r.doc_id, reference("word_bpe_49k.json", texts[r.doc_id]) + [packing.END]), "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)])
        assert r.doc_tokens == len(raw) // 4
        assert r.length == 1 << r.bucket
        assert r.offset == 0
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    assert set(seen) == set(texts)
    for doc, own in seen.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == len(of[doc])
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_packing(docs):
    check_packed(packing.digest(packing.pack(docs(ODD), FILES["word_bpe_49k.json"])).collect(), dict(enumerate(ODD)))


def test_packing_repeats_and_no_rows(docs):
    rows = packing.pack(docs([(1, "a b"), (1, "a b"), (None, "a b")]), FILES["word_bpe_49k.json"]).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 1), (False, 1), (False, 2), (False, 2), (True, 1), (True, 2)]
    assert len({r.sequence_id for r in rows}) == 6
    assert packing.pack(docs([]), FILES["word_bpe_49k.json"]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs([]), FILES["word_bpe_49k.json"], longest=100)


def test_buckets_on_disk(docs, spark, tmp_path):
    packed = packing.pack(docs(["a b c d e f g", "x"]), FILES["word_bpe_49k.json"])
    packing.write_buckets(packed, str(tmp_path / "out"))
    read = spark.read.parquet(str(tmp_path / "out"))
    assert read.where("length != shiftleft(1L, bucket)").count() == 0
    assert read.agg(F.sum("length")).first()[0] == 10


def test_long_texts_go_by_stretches(docs, monkeypatch):
    assert list(tokens.stretches("", 3)) == [""]
    assert list(tokens.stretches("ab cd ef", 3)) == ["ab cd", " ef"]
    monkeypatch.setattr(tokens, "STRETCH", 7)
    cache = tokens.WordCache(FILES["word_bpe_49k.json"])
    for text in [t for t in ODD if t]:
        assert "".join(tokens.stretches(text, 7)) == text
        assert np.frombuffer(cache.encode([text, None])[0], "<u4").tolist() == reference("word_bpe_49k.json", text)


def test_portions():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["x" * n if n else None for n in (0, 5, 900_000, 900_000, 3_000_000, 1, 2)])], ["doc_id", "text"])
    parts = list(packing._portions(batch))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2, 3], [4], [5, 6]]
    assert list(packing._portions(batch.slice(0, 0))) == []


def test_packing_query(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    check_packed(registry.queries()["op3_packing"](spark, small).collect(), texts)


def check_coded(rows, texts):
    assert len(rows) == len(texts)
    own = tokens.load(FILES["byte_bpe_50k.json"])
    for r in rows:
        ids = reference("byte_bpe_50k.json", texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def coded(table):
    path = FILES["byte_bpe_50k.json"]
    both = codec.decode(codec.encode(table, path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"), "text")


def test_codec(docs, monkeypatch):
    rows = coded(docs(ODD)).collect()
    check_coded(rows, dict(enumerate(ODD)))
    assert {r.doc_id: r.text for r in rows} == {k: t or "" for k, t in enumerate(ODD)}


def test_decoding_where_ids_are_joined(docs, monkeypatch):
    monkeypatch.setattr(codec, "CHUNK_CHARS", 50)
    path = FILES["byte_bpe_50k.json"]
    for texts in ([*enumerate(ODD), (None, "x"), (None, None), (3, ODD[3])], []):
        table = docs(texts)
        at_once = codec.encode(table, path, decoded=True)
        apart = codec.decode(codec.encode(table, path), path)
        assert at_once.columns == apart.columns == ["doc_id", "n_tokens", "ids", "text"]
        rows = [sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, bytes(r.ids), r.text) for r in df.collect())) for df in (at_once, apart)]
        assert rows[0] == rows[1]
        assert len(rows[0]) == len(texts)


def test_codec_over_chunks_and_repeats(docs, spark):
    texts = [(k % 30, f"same words {k % 30} " * (1 + k % 30)) for k in range(90)] + [(None, "x"), (None, None)]
    rows = coded(docs(texts).repartition(3)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in rows if r.doc_id is not None) == sorted((False, i, t) for i, t in texts if i is not None)
    assert sorted(r.text for r in rows if r.doc_id is None) == ["", "x"]
    assert coded(docs([])).count() == 0


def test_texts_without_spaces(docs, monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(chr(0x4E00 + k) for k in rng.integers(0, 3_000, n)) for n in (3, 50, 3_000, 3_000, 20_000)]
    texts += [texts[3] + "。" + texts[1], texts[4], "ok " + texts[4] + " ok"]
    monkeypatch.setattr(codec, "LONGEST_KEPT", 100)
    check_coded(coded(docs(texts)).collect(), dict(enumerate(texts)))


def test_plans_that_may_change_are_stored_first(docs, spark, tmp_path):
    docs(["a b", "c"]).select("doc_id", F.col("lang").alias("x")).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert codec._repeatable(table.where("doc_id >= 0").withColumn("y", F.lit(1)))
    for other in (table.repartition(2), table.withColumn("r", F.rand()), table.mapInArrow(lambda b: b, table.schema), table.limit(1), table.join(table, "doc_id")):
        assert not codec._repeatable(other)
    noisy = docs([f"some words {k}" for k in range(200)]).select("doc_id", F.lit("a b").alias("lang"), F.when(F.rand() < 0.5, "one two").otherwise("three").alias("words"))
    rows = coded(noisy.select("doc_id", F.col("words").alias("text"))).collect()
    check_coded(rows, {r.doc_id: r.text for r in rows})


def test_invalid_bytes_decode_to_the_replacement(spark):
    path = FILES["byte_bpe_50k.json"]
    table = codec.pieces(path)
    half = next(i for i, b in enumerate(table) if b == b"\xc3")
    ids = np.array([half, table.index(b"a")], "<u4").tobytes()
    rows = spark.createDataFrame([(1, bytearray(ids)), (2, None)], "k int, ids binary")
    got = {r.k: r.text for r in codec.decode(rows, path).collect()}
    assert got == {1: tokens.load(path).decode([half, table.index(b"a")], skip_special_tokens=False), 2: ""}


def test_codec_query(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    check_coded(registry.queries()["op10_bpe_codec"](spark, small).collect(), texts)
