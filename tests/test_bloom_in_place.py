"""A filter that goes to every task answers as one that is joined does."""

import pytest
from pyspark.sql import functions as F

from lamella.operators import bloom


def answers(values, filter_, p):
    return sorted((r.value, r.found) for r in bloom.contains(values, "v", filter_, p).collect())


@pytest.mark.parametrize("portable", [False, True])
def test_equals_the_join(spark, monkeypatch, portable):
    p = bloom.optimal(300, 0.02, portable=portable)
    members = spark.range(300).select(F.concat(F.lit("m"), "id").alias("v"))
    others = spark.range(2_000).select(F.concat(F.lit("o"), "id").alias("v"))
    values = members.union(others).union(members).union(spark.createDataFrame([(None,), ("",)], "v string"))
    filter_ = bloom.build(members, "v", p)
    folded, q = bloom.fold(filter_, p, 30)
    for f, own in ((filter_, p), (folded, q), (filter_.where("false"), p)):
        in_place = answers(values, f, own)
        with monkeypatch.context() as m:
            m.setattr(bloom, "IN_PLACE_BITS", 0)
            assert answers(values, f, own) == in_place
        assert len(in_place) == 2_301
    assert all(found for value, found in answers(members, filter_, p))
    assert not any(found for _, found in in_place)


def test_plan_has_no_join(spark):
    p = bloom.optimal(100, 0.01)
    values = spark.range(10).select(F.col("id").cast("string").alias("v"))
    plan = bloom.contains(values, "v", bloom.build(values, "v", p), p)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
