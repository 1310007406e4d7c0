import pytest
from pyspark.sql import functions as F

from evkit.operators import profile as P
from tests.conftest import rows_of, table


@pytest.fixture(scope="module")
def zones(spark):
    values = ["a"] * 5 + ["b"] * 3 + ["c"] * 3 + [None] * 5
    return table(spark, "z string", [(v,) for v in values])


def test_frequency_table_null_policy(zones):
    assert rows_of(P.frequency_table(zones, "z")) == [
        (None, 5, 31.25), ("a", 5, 31.25), ("b", 3, 18.75), ("c", 3, 18.75)]
    without = P.frequency_table(zones, "z", drop_null=True, scale=1)
    assert rows_of(without) == [("a", 5, 45.5), ("b", 3, 27.3), ("c", 3, 27.3)]


def test_frequency_top_keeps_the_full_base(zones):
    got = P.frequency_table(zones, "z", top=2, drop_null=True, scale=1)
    assert [tuple(r) for r in got.collect()] == [("a", 5, 45.5), ("b", 3, 27.3)]


def test_frequency_counts_sum_to_rows(zones):
    assert P.frequency_table(zones, "z").agg(F.sum("count")).first()[0] == zones.count()


def test_frequency_of_nothing(zones):
    assert P.frequency_table(zones.limit(0), "z").count() == 0


def test_top_k_ties_and_nulls(spark):
    df = table(spark, "k string, v int", [("b", 1), ("a", 1), ("c", 2), ("d", None)])
    top = P.top_k(df, "v", 2, tiebreak=["k"])
    assert [r.k for r in top.collect()] == ["c", "a"]
    low = P.top_k(df, "v", 4, desc=False, tiebreak=["k"])
    assert [r.k for r in low.collect()] == ["a", "b", "c", "d"]


@pytest.mark.parametrize("n", [1, 3, 4, 9])
def test_both_tails_size_and_order(spark, n):
    df = table(spark, "k int, v double", [(i, float(i * i)) for i in range(n)])
    got = [r.v for r in P.both_tails(df, "v", 4, "k").collect()]
    assert len(got) == min(4, n)
    assert got == sorted(got, reverse=True)
    assert {0.0, float((n - 1) ** 2)} <= set(got)


def test_rankings(spark):
    df = table(spark, "k string, a double, b double", [("x", 1.0, 9.0), ("y", 2.0, 9.0), ("z", None, 1.0)])
    got = P.rankings(df, "k", ["a", "b"], 2)
    assert rows_of(got, "metric", "rank", "k", "score") == [
        ("a", 1, "y", 2.0), ("a", 2, "x", 1.0), ("b", 1, "x", 9.0), ("b", 2, "y", 9.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    worst = P.rankings(df, "k", ["b"], 1, desc=False)
    assert rows_of(worst, "k", "score") == [("z", 1.0)]


def test_rankings_beyond_the_group_limit(spark):
    df = spark.range(3000).selectExpr("id AS k", "id * 2 AS a", "-id AS b")
    got = P.rankings(df, "k", ["a", "b"], 2000)
    assert got.count() == 4000
    assert rows_of(got.filter("rank = 2000"), "metric", "k") == [("a", 1000), ("b", 1999)]


def test_numbers_rank_as_numbers(spark):
    df = table(spark, "k string, pct double", [("a", 9.0), ("b", 71.0), ("c", 100.0)])
    assert [r.k for r in P.top_k(df, "pct", 3).collect()] == ["c", "b", "a"]


def test_deviation(spark):
    df = table(spark, "k string, v double", [("a", 1.0), ("b", 2.0), ("c", None), ("d", 4.0)])
    got = P.deviation(df, ["v"], 1)
    assert rows_of(got, "k", "v_dev") == [("a", -1.3), ("b", -0.3), ("c", None), ("d", 1.7)]


def test_minmax(spark):
    df = table(spark, "v double", [(2.0,), (4.0,), (3.0,)])
    got = [round(r[0], 6) for r in P.minmax(df, "v").orderBy("v").select("v_norm").collect()]
    assert got == [0.0, 0.5, 1.0]
    same = P.minmax(table(spark, "v double", [(2.0,), (2.0,)]), "v")
    assert [r.v_norm for r in same.collect()] == [0.0, 0.0]


def test_mode_takes_the_smallest_tie(zones):
    assert P.mode_value(zones.filter("z <> 'a'"), "z").first().top_value == "b"
    assert P.mode_value(zones, "z").first().top_value == "a"


def test_kpis(spark):
    df = table(spark, "g string, made boolean, z string", [
        ("x", True, "b"), ("x", False, "a"), ("x", None, "b"), ("y", True, None)])
    assert tuple(P.kpis(df, "made", "z", scale=1).first()) == (4, 2, 2, 50.0, "b")
    assert rows_of(P.kpis(df, "made", "z", ["g"], 1)) == [
        ("x", 3, 1, 2, 33.3, "b"), ("y", 1, 1, 0, 100.0, None)]


def test_kpis_of_nothing(spark):
    df = table(spark, "made boolean, z string", [])
    assert tuple(P.kpis(df, "made", "z").first()) == (0, 0, 0, 0.0, None)


def test_argmax_row_tie_and_null(spark):
    df = table(spark, "g int, k string, v double", [
        (1, "b", 2.0), (1, "a", 2.0), (1, "c", None), (2, "d", 1.0), (2, "e", 0.0)])
    assert rows_of(P.argmax_row(df, "v", "k", ["g"])) == [(1, "a", 2.0), (2, "d", 1.0)]
    assert rows_of(P.argmax_row(df, "v", "k", desc=False)) == [(2, "e", 0.0)]


def test_distinct_and_dedupe(spark):
    df = table(spark, "k string, o int, v string", [
        ("a", 2, "late"), ("a", 1, "early"), ("b", 1, "only"), ("b", 1, "only"), (None, 1, "n")])
    assert [r.k for r in P.distinct_values(df, "k").collect()] == ["a", "b"]
    assert P.dedupe(df).count() == 4
    assert rows_of(P.dedupe(df, ["k"], ["o"])) == [
        (None, 1, "n"), ("a", 1, "early"), ("b", 1, "only")]
    with pytest.raises(ValueError):
        P.dedupe(df, ["k"])


def test_facets_give_each_level_and_skip_nulls(spark):
    df = table(spark, "a string, b string", [("x", "p"), ("x", "q"), ("x", None), (None, "p")])
    got = P.facet_counts(df, ["a", "b"])
    assert rows_of(got) == [
        (None, None, 4, 0), ("x", None, 3, 1), ("x", "p", 1, 2), ("x", "q", 1, 2)]


def test_value_range_and_means(spark):
    df = table(spark, "q int, v double", [(1, 5.0), (4, 1.0), (None, None)])
    assert tuple(P.value_range(df, ["q", "v"]).first()) == (1, 4, 1.0, 5.0)
    assert tuple(P.global_means(df, ["q", "v"]).first()) == (2.5, 3.0)
