"""Texts of values, identifiers and stacks, and selections, on small rows."""

import pytest
from pyspark.sql import functions as F

from heapsift.functions import text as X
from heapsift.operators import views


def test_value_text(spark):
    row = spark.range(1).select(
        X.value_text("ref", F.lit(255)), X.value_text("ref", F.lit(0)), X.value_text("boolean", F.lit(True)), X.value_text("char", F.lit(65)), X.value_text("char", F.lit(10)),
        *[X.value_text("double", F.lit(x)) for x in (1.0, -0.5, 1e21, 1.5e-7, 123456789.25, 0.0, float("inf"), float("nan"))], X.value_text("long", F.lit(-7)))
    assert list(row.first()) == ["0xff", "null", "true", "'A'", "\\u000a", "1", "-0.5", "1" + "0" * 21, "0.00000015", "123456789.25", "0", "inf", "NaN", "-7"]


def test_parse_id(spark):
    texts = ["0x10", " @0XfF ", "12", "@@7", "+5", "0", "0x", "", "x", "-1", "18446744073709551615", "18446744073709551616", "0xffffffffffffffff", "0x1ffffffffffffffff", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.parse_id(F.col("t")).alias("id")).orderBy("i").collect()
    assert [r.id for r in rows] == [16, 255, 12, 7, 5, None, None, None, None, None, -1, None, -1, None, None]


def test_duration(spark):
    rows = spark.createDataFrame([(x,) for x in (0, 999, 1000, 1500, 59999, 60000, 125000, 3599500, 3607000)], "ms long").select(X.duration(F.col("ms"))).collect()
    assert [r[0] for r in rows] == ["0ms", "999ms", "1.0s", "1.5s", "60.0s", "1m00s", "2m05s", "1h00m00s", "1h00m07s"]


def test_where_takes_the_most_derived_field(spark):
    values = spark.createDataFrame([(1, "a.B", "x", 0, "1"), (1, "a.B", "x", 1, "2"), (2, "a.B", "x", 0, "2"), (3, "a.C", "x", 0, "2"), (4, "a.B", "x", 0, None)], "obj long, class string, field string, depth int, text string")
    assert [r.obj for r in views.where(values, "=B.x=2").collect()] == [2]
    assert sorted(r.obj for r in views.where(values, "a.*.x=2").collect()) == [2, 3]
    with pytest.raises(ValueError):
        views.where(values, "B.y=2")
    with pytest.raises(ValueError):
        views.parse_where("B")


def test_stacks(spark):
    frames = spark.createDataFrame([(1, 10, 11, 5, 12), (2, 10, None, 6, -3), (3, 99, 11, 5, -2)], "id long, method_sym long, source_sym long, class_serial long, line int")
    symbols = spark.createDataFrame([(10, "run"), (11, "A.java")], "id long, text string")
    classes = spark.createDataFrame([(5, "p.A")], "serial long, name string")
    traces = spark.createDataFrame([(7, [1, 2, 255, 3]), (8, [])], "serial long, frames array<long>")
    rows = views.stacks(traces, views.frames(frames, symbols, classes)).orderBy("depth").collect()
    assert [r.text for r in rows] == ["p.A.run(A.java:12)", "?.run", "<frame 0xff>", "p.A.?(A.java compiled)"]


def test_direct_buffers_of_no_rows(spark):
    none = views.direct_buffers(spark.createDataFrame([], "obj long, capacity long"), spark.createDataFrame([], "src long, label string"))
    assert list(views.direct_totals(none).first()) == [0, 0, 0, 0, 0]
