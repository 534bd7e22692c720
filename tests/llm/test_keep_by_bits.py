"""The pipeline's rule filter decides by the ledger's failure bits and policy masks."""

from pyspark.sql import functions as F

from lamella.llm import quality_rules

GOOD = " ".join(f"word{k}" for k in range(60))


def test_keep_filters_on_failure_bits(docs, monkeypatch):
    table = docs([GOOD, "short", None, GOOD + " #" * 40, (None, "short")])
    monkeypatch.setattr(quality_rules, "passes", lambda policy: F.col("failed") == quality_rules.BIT["symbols"])
    assert [r[0] for r in quality_rules.keep(table).collect()] == [3]


def test_keep_uses_the_ledgers_bits(docs, monkeypatch):
    table = docs([GOOD, "short"])
    monkeypatch.setattr(quality_rules, "failure_bits", lambda: F.lit(quality_rules.BIT["too_short"]).cast("long"))
    assert quality_rules.keep(table).count() == 0


def test_kept_rows_are_unchanged(docs):
    table = docs([GOOD, "short", (None, GOOD), (0, GOOD)]).withColumnRenamed("bucket", "failed").withColumnRenamed("cls", "n_words")
    kept = quality_rules.keep(table)
    assert kept.dtypes == table.dtypes
    rows = [tuple(r) for r in table.collect()]
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(str(r) for r in rows if r[1] == GOOD)
