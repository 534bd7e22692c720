from pyspark.sql import functions as F

from lamella.functions import codec


def values(spark, kind, items, column):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(items)], f"k int, v {kind}").orderBy("k").select(column(F.col("v"))).collect()]


def test_zigzag(spark):
    items = [0, 22, -33, 2**31 - 1, -(2**31), 2**63 - 1, -(2**63), -7363025924956902506]
    got = values(spark, "long", items, codec.zigzag)
    assert [int(v) for v in got] == [2 * n if n >= 0 else -2 * n - 1 for n in items]
    assert values(spark, "long", items, lambda c: codec.unzigzag(codec.zigzag(c))) == items


def test_varint_length(spark):
    items = [0, 127, 128, 16_383, 16_384, 2**35, 2**56, 2**63 - 1]
    assert values(spark, "long", items, codec.varint_length) == [max(1, -(-n.bit_length() // 7)) for n in items]


def test_sizes(spark):
    assert values(spark, "string", ["", "a", "é", "x" * 200], codec.text_bytes) == [1, 2, 3, 202]
    assert values(spark, "array<string>", [[], ["a", ""]], codec.list_bytes) == [1, 4]


def test_bits(spark):
    items = [[], [True, False, True], [True] * 8, [False] * 8 + [True], [k % 3 == 0 for k in range(1024)]]
    packed = values(spark, "array<boolean>", items, codec.pack_bits)
    assert [len(p) for p in packed] == [-(-len(i) // 8) for i in items]
    assert packed[1] == [5]
    assert values(spark, "array<boolean>", items, lambda c: codec.unpack_bits(codec.pack_bits(c), F.size(c))) == items


def test_numbers(spark):
    assert values(spark, "string", ["12", " -3x", "x", "", "+7.9"], codec.to_int) == [12, -3, 0, 0, 7]
    assert values(spark, "array<long>", [[], [1, 2], [7, 8, 9]], codec.truncated_mean) == [0, 1, 8]
    assert values(spark, "long", [255, 256, 65_535, 65_536], codec.code_width) == [1, 2, 2, 4]
