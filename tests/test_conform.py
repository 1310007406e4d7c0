from pyspark.sql import functions as F

from evkit.operators import conform as C
from tests.conftest import rows_of, table


def test_split_name_by_word_count(spark):
    df = table(spark, "n string", [("Solo",), ("Boston Celtics",), ("Los Angeles Lakers",),
                                   ("A B C D",), (None,)])
    got = {r.n: (r.h, r.t) for r in C.split_name(df, "n", "h", "t").collect()}
    assert got == {
        "Solo": ("Solo", None),
        "Boston Celtics": ("Boston", "Celtics"),
        "Los Angeles Lakers": ("Los Angeles", "Lakers"),
        "A B C D": ("A", "B"),
        None: (None, None),
    }


def test_conform_keys(spark):
    df = table(spark, "c string", [("bkn",), ("Bos",), (None,)])
    mapping = table(spark, "source string, target string", [("BKN", "BRO")])
    got = C.conform_keys(df, "c", mapping, "code", upper=True)
    assert rows_of(got) == [(None, None), ("Bos", "BOS"), ("bkn", "BRO")]


def test_recode_keeps_other_values(spark):
    df = table(spark, "c string", [("BKN",), ("BOS",), (None,)])
    assert rows_of(df.select(C.recode("c", {"BKN": "BRO"}))) == [(None,), ("BOS",), ("BRO",)]


def test_add_key_is_null_when_a_part_is(spark):
    df = table(spark, "a string, b string", [("x", "y"), ("x", None)])
    assert rows_of(C.add_key(df, ["a", "b"], "k"), "k") == [(None,), ("x_y",)]


def test_qualify(spark):
    df = table(spark, "gp int", [(49,), (50,), (None,)])
    assert rows_of(C.qualify(df, "gp", 50)) == [(None, "No"), (49, "No"), (50, "Yes")]


def test_drop_incomplete(spark):
    df = table(spark, "a int, b int", [(1, None), (None, 2), (1, 2)])
    assert rows_of(C.drop_incomplete(df)) == [(1, 2)]
    assert rows_of(C.drop_incomplete(df, ["b"])) == [(None, 2), (1, 2)]


def test_slice_rows_by_list_and_table(spark):
    df = table(spark, "a string, b int", [("x", 1), ("y", 1), ("x", 2), (None, 1)])
    assert rows_of(C.slice_rows(df, a=["x"], b=[1])) == [("x", 1)]
    wanted = table(spark, "v string", [("x",), ("x",)])
    assert rows_of(C.slice_rows(df, a=wanted)) == [("x", 1), ("x", 2)]
    # Long lists are joined.
    many = [None, *range(2, C.MAX_INLINE_VALUES * 3)]
    assert rows_of(C.slice_rows(df, b=many)) == [("x", 2)]


def test_fill_missing(spark):
    df = table(spark, "a double, b string", [(1.0, None), (None, "x"), (3.0, "y")])
    got = C.fill_missing(df, {"b": "Unknown"}, ["a"])
    assert rows_of(got) == [(1.0, "Unknown"), (2.0, "x"), (3.0, "y")]


def test_ratio_and_scale(spark):
    df = table(spark, "a double, b double", [(6.0, 3.0), (1.0, 0.0)])
    assert rows_of(C.add_ratio(df, "a", "b", "r"), "r") == [(None,), (2.0,)]
    assert rows_of(C.scale_columns(df, ["a"]), "a", "b") == [(100.0, 0.0), (600.0, 3.0)]
    assert C.scale_columns(df, ["a"]).select(F.max("b")).first()[0] == 3.0
