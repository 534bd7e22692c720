"""The pipeline's stages, one after the other, against brute-force versions of their decisions."""

import ast
import pathlib
import re

import corpus_pipeline
import pytest

from lamella.llm import common, registry
from test_near_dedup import brute
from test_spans import secret_spans
from test_tokens import check_packed

ROOT = pathlib.Path(corpus_pipeline.__file__).parent


@pytest.fixture(scope="module")
def kept(spark, small):
    docs, out = common.table(spark, small, "documents"), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, small), name)
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def test_language_stage(kept):
    gone = {r.doc_id for r in kept["documents"]} - {r.doc_id for r in kept["language_id"]}
    assert len(gone) <= 0.01 * len(kept["documents"])
    assert set(kept["language_id"]) <= set(kept["documents"])


def test_quality_stage(kept, spark, small):
    verdict = {r.doc_id: r.kept for r in registry.queries()["op9_quality_rules"](spark, small).collect()}
    assert sorted(kept["quality_rules"]) == sorted(r for r in kept["language_id"] if verdict[r.doc_id])


def test_dedup_stage(kept):
    head = brute([(r.doc_id, r.text) for r in kept["quality_rules"]])
    assert sorted(kept["near_dedup"]) == sorted(r for r in kept["quality_rules"] if head[r.doc_id] == r.doc_id)


def test_secret_stage(kept):
    before = {r.doc_id: r for r in kept["near_dedup"]}
    assert {r.doc_id for r in kept["secret_scan"]} == set(before)
    for r in kept["secret_scan"]:
        old = before[r.doc_id]
        assert not secret_spans(r.text)
        assert r.n_chars == len(r.text)
        assert (r.text == old.text) == (not secret_spans(old.text)) or "[SECRET]" in r.text


def test_packing_stage(kept):
    check_packed(kept["packing"], {r.doc_id: r.text for r in kept["secret_scan"]})


def test_run(spark, small, kept):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    assert sorted(map(key, corpus_pipeline.run(spark, small).collect())) == sorted(map(key, kept["packing"]))
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_of_no_rows(docs, spark, small):
    rows = docs([])
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, small)
    assert rows.count() == 0


def test_every_operator_is_registered():
    names = [n for n in registry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "lamella").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_native_operators_use_no_python(spark, small):
    for name in ("op1_pii", "op2_secret_scan", "op5_sharding"):
        plan = registry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


