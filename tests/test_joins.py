import pytest

from evkit.operators import joins as J
from evkit.operators.entity import entity_profile, entity_vs_average
from tests.conftest import rows_of, table


def test_one_dimension_in_two_roles(spark):
    fact = table(spark, "own string, other string", [("a", "b"), ("b", "z"), (None, "a")])
    dim = table(spark, "code string, size int", [("a", 1), ("b", 2)])
    got = J.denormalize(fact, [(dim, {"own": "code"}, "own_"), (dim, {"other": "code"}, "other_")])
    assert got.columns == ["own", "other", "own_size", "other_size"]
    assert rows_of(got) == [(None, "a", None, 1), ("a", "b", 1, 2), ("b", "z", 2, None)]


def test_two_column_key(spark):
    fact = table(spark, "n string, t string", [("x", "A"), ("x", "B"), ("y", "A")])
    dim = table(spark, "name string, team string, v int", [("x", "A", 1), ("x", "B", 2)])
    got = J.denormalize(fact, [(dim, {"n": "name", "t": "team"}, "")])
    assert rows_of(got) == [("x", "A", 1), ("x", "B", 2), ("y", "A", None)]


def test_unmatched_and_duplicate_keys(spark):
    fact = table(spark, "k string", [("a",), ("b",), ("b",), (None,)])
    dim = table(spark, "code string", [("a",), ("a",)])
    assert rows_of(J.unmatched_keys(fact, dim, {"k": "code"})) == [(None, 1), ("b", 2)]
    assert rows_of(J.duplicate_keys(dim, ["code"])) == [("a", 2)]


def test_lookup_mean_averages_repeated_keys_and_fills_the_rest(spark):
    fact = table(spark, "who string", [("x",), ("new",), (None,)])
    dim = table(spark, "name string, a double, b double",
                [("x", 0.2, 1.0), ("x", 0.4, 3.0), ("y", 0.9, None)])
    got = J.lookup_mean(fact, dim, {"who": "name"}, {"a": "ma", "b": "mb"})
    rows = {r.who: (round(r.ma, 6), r.mb) for r in got.collect()}
    assert rows == {"x": (0.3, 2.0), "new": (0.5, 2.0), None: (0.5, 2.0)}
    bare = J.lookup_mean(fact, dim, {"who": "name"}, {"a": "ma"}, default=None)
    assert bare.filter("who = 'new'").first().ma is None


def test_entity_profile(spark):
    players = table(spark, "name string, gp int", [("x", 60), ("y", 55), ("z", 51)])
    shots = table(spark, "shooter string", [("x",), ("x",), ("y",), (None,)])
    summary = table(spark, "name string, total int", [("x", 12)])
    got = entity_profile(players, shots, summary, "name", fact_key="shooter")
    assert rows_of(got, "name", "attempts", "total", "has_profile") == [
        ("x", 2, 12, True), ("y", 1, None, False), ("z", 0, None, False)]


def test_entity_vs_average(spark):
    df = table(spark, "name string, ts double, ortg double", [("x", 0.5, 100.0), ("y", 0.6, 110.0)])
    got = entity_vs_average(df, "name", ["ts", "ortg"], ["ts"], scale=1)
    row = got.filter("name = 'y'").first()
    assert (row.ts, row.ts_mean, row.ts_dev) == (60.0, 55.0, 5.0)
    assert row.ts_text == "+5.0% vs league avg"
    assert row.ortg_text == "+5.0 vs league avg"


def test_hot_keys_are_split_and_nothing_is_lost(spark):
    """With dimensions too large to broadcast, the partition of a hot key is read by many tasks."""
    confs = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    old = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        # A third of the rows has one key, another third has none.
        fact = spark.range(0, 60_000, 1, 8).selectExpr(
            "id", "CASE id % 3 WHEN 0 THEN 7 WHEN 1 THEN NULL ELSE id END AS k")
        dim = spark.range(0, 30_000).selectExpr("id AS code", "id * 2 AS v")
        got = J.denormalize(fact, [(dim, {"k": "code"}, "")])
        rows = got.selectExpr("count(*) AS n", "count(v) AS hits", "sum(v) AS total").first()
        assert rows.n == 60_000
        assert rows.hits == 20_000 + 10_000
        wide = got.repartition(1)
        wide.write.format("noop").mode("overwrite").save()
        wide.collect()
        assert "skewed" in wide._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_dimensions_must_be_unique(spark):
    dim = table(spark, "k int, v string", [(1, "a"), (2, "b"), (2, "c")])
    assert J.require_unique(dim.filter("k = 1"), ["k"]).count() == 1
    with pytest.raises(ValueError, match="teams has several rows for: 2"):
        J.require_unique(dim, ["k"], "teams")
