import math

import pytest

from lamella.operators import bloom


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w,) for w in ["AbC", "iJk", "XYZ", *map(str, range(100))]], "w string")


P = bloom.optimal(1_000, 1e-4)


def test_parameters():
    assert P.bits % 8 == 0
    for k in range(1, 60):
        assert -P.hashes * 1_000 / math.log(1 - 1e-4 ** (1 / P.hashes)) <= -k * 1_000 / math.log(1 - 1e-4 ** (1 / k)) + 1e-6
    assert bloom.optimal(55_000, 0.1, most_bits=1_000).bits == 1_000
    for wrong in ((0, 0.1), (10, 0.0), (10, -1.0), (10, math.inf)):
        with pytest.raises(ValueError):
            bloom.optimal(*wrong)
    with pytest.raises(ValueError):
        bloom.optimal(10, 0.1, seed=0)


def test_no_false_negatives_and_few_false_positives(spark, words):
    own = bloom.build(words, "w", P)
    assert bloom.contains(words, "w", own, P).where("not found").count() == 0
    others = spark.createDataFrame([(w,) for w in ["AbCX", "iJkX", "XYZX", *(str(-k) for k in range(1, 100))]], "w string")
    assert bloom.contains(others, "w", own, P).where("found").count() <= 2
    row = bloom.contains_all(words, "w", own, P).first()
    assert row.all_found and not row.none_found and row.first_missing is None and row.first_found == "0"


def test_algebra(spark, words):
    a, b = words.where("w < '5'"), words.where("w >= '3'")
    fa, fb = bloom.build(a, "w", P), bloom.build(b, "w", P)
    bits = lambda f: {r.bit for r in bloom.set_bits(f).collect()}
    assert bits(bloom.union(fa, fb, P, P)) == bits(fa) | bits(fb) == bits(bloom.build(words, "w", P))
    assert bits(bloom.intersection(fa, fb, P, P)) == bits(fa) & bits(fb)
    assert bits(bloom.difference(fa, fb, P, P)) == bits(fa) ^ bits(fb)
    with pytest.raises(ValueError):
        bloom.union(fa, fb, P, bloom.optimal(7, 0.1))


def test_fold_until_refused(words):
    own, p = bloom.build(words, "w", P), P
    for _ in range(3):
        own, p = bloom.fold(own, p, 60)
        assert bloom.contains(words, "w", own, p).where("not found").count() == 0
    for percent in (-1, 100, 0):
        with pytest.raises(ValueError):
            bloom.fold(own, p, percent)


def test_rates(spark, words):
    own = bloom.build(words, "w", P)
    row = bloom.measured_fpp(own, P).first()
    assert 0 < row.fpp < bloom.expected_fpp(P, 103) * 2
    empty = bloom.build(spark.createDataFrame([(None,)], "w string"), "w", P)
    assert empty.count() == 0
    assert bloom.measured_fpp(empty, P).first().fpp == 0
    assert bloom.contains(words, "w", empty, P).where("found").count() == 0


def test_descriptions(words):
    own = bloom.build(words, "w", P)
    row = bloom.describe(own, P, 103).first()
    assert (row.bits, row.hashes, row.seed, row.folds, row.is_empty) == (P.bits, P.hashes, P.seed, 0, False)
    assert row.bits_set == bloom.set_bits(own).count()
    assert bloom.same(own, bloom.build(words.union(words), "w", P), P, P)
    assert not bloom.same(own, bloom.build(words.where("w != 'XYZ'"), "w", P), P, P)
    assert bloom.describe(own.limit(0), P, 0).first().is_empty
