import pytest
from pyspark.sql import functions as F

from evkit.operators import value as V
from tests.conftest import rows_of, table

SCHEMA = "game int, team string, xp double, pts int"
EVENTS = [
    (1, "A", 1.0, 2), (1, "A", 0.5, 0),  # over by 0.5
    (1, "B", 2.0, 2),                    # exactly as expected: under
    (2, "A", 1.5, 0),                    # under by 1.5
    (2, "B", 0.0, 0),                    # nothing expected
    (3, "A", 0.5, 3),                    # over by 2.5
    (3, None, 1.0, 3),
    (4, "C", 1.0, 3),                    # only ever over
]


@pytest.fixture(scope="module")
def events(spark):
    return table(spark, SCHEMA, EVENTS)


def test_expected_value(spark):
    df = table(spark, "value int, prob double, label int", [(3, 0.5, 1), (2, 0.25, 0)])
    got = V.expected_value(df, "value", "prob", "label")
    assert rows_of(got, "xp", "pts") == [(0.5, 0), (1.5, 3)]


def test_games(events):
    got = V.over_under_games(events, "game", "team")
    rows = {(r.game, r.team): (r.over, r.delta, r.delta_pct) for r in got.collect()}
    assert rows[(1, "A")] == ("yes", 0.5, pytest.approx(100 / 3))
    assert rows[(1, "B")] == ("no", 0.0, 0.0)
    assert rows[(2, "B")] == ("no", 0.0, None)
    assert rows[(2, "A")] == ("no", -1.5, -100.0)


def test_games_without_entity(events):
    got = V.over_under_games(events, "game")
    assert "team" not in got.columns
    assert rows_of(got, "game", "total_xp", "total_pts")[0] == (1, 3.5, 4)


def test_summary(events):
    got = {r.team: r for r in V.over_under(events, "game", "team").collect()}
    assert set(got) == {"A", "B", "C"}
    a = got["A"]
    assert (a.outperform, a.underperform, a.total) == (2, 1, 3)
    assert (a.outperform_pct, a.underperform_pct, a.underperform_pct_neg) == (67.0, 33.0, -33.0)
    assert a.avg_delta == 0.5
    assert got["B"].avg_delta_pct == 0.0  # the game without expectation is left out
    assert (got["C"].outperform, got["C"].underperform) == (1, 0)


def test_min_games_and_nulls(events):
    kept = V.over_under(events, "game", "team", min_games=2)
    assert rows_of(kept, "team") == [("A",), ("B",)]
    sql_habit = V.over_under(events, "game", "team", drop_null=False)
    assert rows_of(sql_habit, "team") == [(None,), ("A",), ("B",), ("C",)]


def test_pivot_equals_counts(events):
    games = V.over_under_games(events.filter("team IS NOT NULL"), "game", "team")
    summary = V.summarize_games(games, "team").select("team", "outperform", "underperform")
    assert rows_of(V.over_under_pivot(games, "team")) == rows_of(summary)
    only_over = games.filter("over = 'yes'")
    assert rows_of(V.over_under_pivot(only_over, "team"), "underperform") == [(0,), (0,)]


def test_deltas_add_up(events):
    games = V.over_under_games(events, "game", "team")
    total = events.agg(F.sum("pts") - F.sum("xp")).first()[0]
    assert games.agg(F.sum("delta")).first()[0] == pytest.approx(total)


def test_repartitioning_changes_nothing(events):
    one = V.over_under(events.repartition(1), "game", "team")
    many = V.over_under(events.repartition(6), "game", "team")
    assert rows_of(one) == rows_of(many)
