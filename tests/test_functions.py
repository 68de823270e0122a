import pytest
from pyspark.sql import functions as F

from arborlens.functions.vectors import known_value, mean_pool, pack_floats, unit_length, unpack_floats, utc_text
from arborlens.model import EDGE_KINDS, SYMBOL_KINDS, confidence_rank, snake_kind


def test_vectors(spark):
    frame = spark.createDataFrame([([1.5, -2.0],), ([],), (None,)], "v array<float>")
    assert [r[0] for r in frame.select(unpack_floats(pack_floats("v"))).collect()] == [[1.5, -2.0], [], None]
    assert spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(unpack_floats("b")).first()[0] is None
    states = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0]], [0]), ([], [])], "s array<array<double>>, m array<int>")
    assert [r[0] for r in states.select(mean_pool(F.col("s"), F.col("m"))).collect()] == [[2.0, 3.0], [0.0], []]
    lengths = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(unit_length(F.col("v")))
    assert [r[0] for r in lengths.collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_time_and_codes(spark):
    assert spark.createDataFrame([(1706702400,)], "s bigint").select(utc_text(F.col("s"))).first()[0] == "2024-01-31T12:00:00Z"
    kinds = spark.createDataFrame([("calls",), (None,)], "k string")
    assert [r[0] for r in kinds.select(known_value(F.col("k"), EDGE_KINDS, "edge kind")).collect()] == ["calls", None]
    with pytest.raises(Exception, match="unknown edge kind: odd"):
        spark.createDataFrame([("odd",)], "k string").select(known_value(F.col("k"), EDGE_KINDS, "edge kind")).collect()
    assert len(EDGE_KINDS) == 16 and len(SYMBOL_KINDS) == 14
    names = spark.createDataFrame([("BarrelReExportAll",), ("calls",), ("Odd",)], "k string").select(snake_kind(F.col("k")).alias("k"))
    assert [tuple(r) for r in names.select("k", confidence_rank(F.col("k"))).collect()] == [("barrel_re_export_all", 2), ("calls", 3), ("odd", None)]
