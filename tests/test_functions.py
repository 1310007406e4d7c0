from pyspark.sql import functions as F

from evkit import functions as fn
from tests.conftest import rows_of, table


def one(spark, kind, values, expr):
    df = table(spark, f"i int, x {kind}", list(enumerate(values)))
    return [r[1] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_labels(spark):
    assert one(spark, "boolean", [True, False, None], fn.flag_to_label) == [1, 0, 0]
    assert one(spark, "string", ["Made Shot", "MADE", "Missed", None], fn.text_to_label) == [1, 1, 0, 0]


def test_point_values(spark):
    kinds = ["2PT Field Goal", "3PT Field Goal", None]
    assert one(spark, "string", kinds, fn.point_value_from_type) == [2, 3, 3]
    zones = ["Above the Break 3", "Restricted Area", None]
    assert one(spark, "string", zones, fn.point_value_from_zone) == [3, 2, 2]


def test_opponent(spark):
    df = table(spark, "side string, home string, away string",
               [("A", "A", "B"), ("B", "A", "B"), (None, "A", "B")])
    got = df.select(fn.opponent_of("side", "home", "away").alias("o"))
    assert [r.o for r in got.collect()] == ["B", "A", "A"]


def test_over_flag_ties_and_nulls(spark):
    df = table(spark, "pts double, xp double", [(2.0, 1.0), (1.0, 1.0), (None, 1.0), (1.0, None)])
    got = [r.o for r in df.select(fn.over_flag("pts", "xp").alias("o")).collect()]
    assert got == ["yes", "no", "no", "no"]


def test_texts(spark):
    assert one(spark, "double", [71.0, 9.0, None], fn.pct_text) == ["71.0%", "9.0%", None]
    signed = one(spark, "double", [1.23, -0.5, None], lambda c: fn.signed_text(c, 1, "%"))
    assert signed == ["+1.2%", "-0.5%", None]


def test_rounding_modes(spark):
    values = [0.5, 1.5, 2.5]
    assert one(spark, "double", values, lambda c: fn.rounded(c, 0, "half_up")) == [1, 2, 3]
    assert one(spark, "double", values, lambda c: fn.rounded(c, 0, "half_even")) == [0, 2, 2]


def test_safe_ratio(spark):
    df = table(spark, "a int, b int", [(1, 2), (1, 0), (None, 2), (1, None)])
    assert rows_of(df.select(fn.safe_ratio("a", "b"))) == [(None,), (None,), (None,), (0.5,)]
