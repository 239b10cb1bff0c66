"""Names, numbers and parameters as text."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import text
from waymark.operators import mapping


def test_numbers_print_as_python_prints_them(spark):
    rng = random.Random(1)
    values = [1700000000.25, 0.0001, 0.00009999, 1e-5, 1.5e-7, 1e15, 123456789012345680.0, 1e16, 9999999999999998.0, 1e22, 1.25e300, 0.0, -0.0, 1.0, -2.5, 1e7, 1.0e7 + 0.5, 0.001, float("inf"), float("-inf")]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 20) for _ in range(2000)] + [float(rng.randint(0, 10**18)) for _ in range(200)]
    got = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").select("x", text.decimal_text(F.col("x")).alias("s")).collect()
    odd = [r for r in got if r["s"] != (None if r["x"] is None else repr(r["x"]))]
    # beyond 10^16 Java rounds from digits of its own: seldom one more than needed, always the same number
    assert len(got) == len(values) + 1 and len(odd) < 10 and all(abs(r["x"]) >= 1e16 and float(r["s"]) == r["x"] for r in odd)


def test_tum_line_of_a_real_stamp(spark):
    zero = F.lit(0.0)
    line = spark.range(1).select(text.tum_line(F.lit(1700000000.25), [F.lit(0.0001), F.lit(-12.5), zero], [zero, zero, zero, F.lit(1.0)])).first()[0]
    assert line == "1700000000.25 0.0001 -12.5 0.0 0.0 0.0 0.0 1.0"


def test_frames_beyond_a_million(spark):
    df = spark.createDataFrame([(5,), (999_999,), (1_000_000,), (1_000_001,), (10_000_000,)], "n long")
    assert [r[0] for r in df.select(text.frame_name(F.col("n"))).collect()] == ["000005", "999999", "1000000", "1000001", "10000000"]
    assert [r[0] for r in df.select(text.chunk_name(F.col("n"))).collect()][:3] == ["chunk_0005.json", "chunk_999999.json", "chunk_1000000.json"]


def test_overfull_chunks_are_told_and_collide_with_none(spark):
    chunks = spark.createDataFrame([("s", 0, 1, ["YQ=="] * 1002), ("s", 1, 1, ["Yg=="])], "session string, chunk int, at int, frames array<string>")
    got = mapping.saved_frames(chunks, "session", "chunk", "at", "frames")
    assert got.count() == 1001 == got.select("name").distinct().count()
    assert [tuple(r) for r in mapping.overfull_chunks(chunks, "session", "chunk", "frames").collect()] == [("s", 0, 1002)]


def test_repeated_and_odd_parameters(spark):
    rows = ["a:1;a:2;", "a:1;b;;:x;c:;a:3:4", "", None, ";;", "k"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "s string").select(text.params_map(F.col("s"))).collect()]
    assert got == [{"a": "2"}, {"b": None, "c": "", "a": "3:4"}, {}, None, {}, {"k": None}]


def test_namespaces_end_at_the_slash(spark):
    df = spark.createDataFrame([("Visual/MinInliers",), ("VisualX/y",), ("Visual",), (None,)], "k string")
    for names in (["Visual"], ["Visual/"]):
        assert [r[0] for r in df.select(text.in_namespaces(F.col("k"), names)).collect()] == [True, False, False, False]


def test_sanitized_at_any_depth(spark):
    schema = T.StructType().add("a", T.ArrayType(T.StructType().add("t", "string").add("n", "integer"))).add("m", T.MapType(T.StringType(), T.BinaryType())).add("s", "string")
    row = ([("x" * 9, 1), None, ("ok", None)], {"k": b"12345", "z": None}, None)
    df = spark.createDataFrame([(row,), (None,)], T.StructType().add("r", schema))
    got = df.select(text.sanitized(F.col("r"), schema, 5).alias("r")).collect()
    assert got[0]["r"].asDict(recursive=True) == {"a": [{"t": "<9 chars>", "n": 1}, None, {"t": "ok", "n": None}], "m": {"k": "<5 bytes>", "z": None}, "s": None} and got[1]["r"] is None


def test_stamps_of_repeated_stems_do_not_multiply(spark):
    images = spark.createDataFrame([("a",), ("b",)], "stem string")
    metadata = spark.createDataFrame([("a", 2000, 1), ("a", 1000, 2)], "stem string, ms long, at int")
    assert sorted(map(tuple, mapping.with_stamps(images, metadata, "stem", "ms", "at").collect())) == [("a", 1.0), ("b", 0.0)]
