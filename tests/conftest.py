"""Shared session and season fixtures."""

from __future__ import annotations

import pytest

from evkit.plans.season import Season
from evkit.session import build_session
from evkit.sources import schemas as S


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def table(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def rows_of(df, *cols):
    """Rows as a sorted list of tuples, nulls first."""
    picked = df.select(*[f"`{c}`" for c in cols]) if cols else df
    key = lambda r: [(x is not None, str(type(x)) if x is None else x) for x in r]
    return sorted((tuple(r) for r in picked.collect()), key=key)


# (game, player id, player, team name, home, away, made, quarter, mins, secs); zones and types
# follow from the place in the list.
ATTEMPTS = [
    (1, 10, "Ann Ace", "Brooklyn Nets", "BKN", "BOS", True, 1, 11, 40),
    (1, 20, "Bea Bolt", "Boston Celtics", "BKN", "BOS", False, 1, 11, 20),
    (1, 10, "Ann Ace", "Brooklyn Nets", "BKN", "BOS", False, 1, 10, 5),
    (1, 20, "Bea Bolt", "Boston Celtics", "BKN", "BOS", True, 2, 11, 0),
    (1, 30, "Cy Cole", "Boston Celtics", "BKN", "BOS", True, 2, 11, 0),
    (2, 10, "Ann Ace", "Brooklyn Nets", "LAL", "BKN", True, 1, 9, 30),
    (2, 10, "Ann Ace", "Brooklyn Nets", "LAL", "BKN", False, 1, 9, 30),
    (2, 40, "Di Dunk", "Los Angeles Lakers", "LAL", "BKN", True, 1, 9, 10),
    (2, 40, "Di Dunk", "Los Angeles Lakers", "LAL", "BKN", True, 3, 2, 0),
    (2, 50, "Ed Edge", "Los Angeles Lakers", "LAL", "BKN", None, 4, 0, 1),
    (3, 60, "Flo Fox", "Portland Trail Blazers", "POR", "LAC", True, 1, 11, 59),
    (3, 70, "Gus Gray", "Los Angeles Clippers", "POR", "LAC", False, 1, 11, 30),
    (3, 70, "Gus Gray", "Solo", "POR", "LAC", True, 1, 11, 10),
    (3, 80, None, None, "POR", "LAC", False, 1, 10, 0),
]
ZONES = ["Above the Break 3", "Restricted Area", None, "Mid-Range"]
TYPES = ["3PT Field Goal", "2PT Field Goal", None, "2PT Field Goal"]
ACTIONS = ["Jump Shot", "Dunk", "Layup"]


def shot_rows():
    out = []
    for i, (game, pid, name, team, home, away, made, q, m, s) in enumerate(ATTEMPTS):
        event = None if made is None else ("Made Shot" if made else "Missed Shot")
        out.append(
            (game, pid, name, team, home, away, "G" if i % 2 else "F", event, made,
             ACTIONS[i % 3], TYPES[i % 4], ZONES[i % 4], "Center" if i % 2 else "Left Side",
             "8-16 ft." if i % 3 else "24+ ft.", float(i), q, m, s)
        )
    return out


PLAYERS = [
    ("Ann Ace", "Bro", "G", 60, 30.0, 15.0, 0.60, 0.55, 0.52, 0.38, 115.0, 108.0, 25.0),
    ("Bea Bolt", "Bos", "F", 50, 20.0, 10.0, 0.58, 0.54, 0.50, 0.36, 112.0, 107.0, 20.0),
    ("Cy Cole", "Bos", "F", 49, 10.0, 4.0, 0.50, 0.45, 0.44, 0.30, 100.0, 110.0, 12.0),
    ("Di Dunk", "Lal", "C", 70, 25.0, 20.0, 0.65, 0.63, 0.64, 0.25, 120.0, 105.0, 22.0),
    ("Ed Edge", "Lal", "G", None, 5.0, 1.0, 0.40, 0.35, 0.33, 0.20, 90.0, 112.0, 9.0),
    ("Flo Fox", "Por", "G", 55, 0.0, 0.0, 0.55, 0.50, 0.48, 0.35, 110.0, 109.0, 18.0),
    ("Gus Gray", "Lac", "F", 30, 15.0, 6.0, 0.52, 0.47, 0.46, 0.31, 104.0, 111.0, 14.0),
    ("Gus Gray", "Bos", "F", 52, 12.0, 5.0, 0.54, 0.49, 0.50, 0.33, 106.0, 110.0, 13.0),
]

# name, code, conf, division, oPPG, dEFF
TEAMS = [
    ("Brooklyn", "Bro", "East", "Atlantic", 112.0, 112.9),
    ("Boston", "Bos", "East", "Atlantic", 104.5, 107.0),
    ("LA Lakers", "Lal", "West", "Pacific", 115.1, 113.4),
    ("LA Clippers", "Lac", "West", "Pacific", 108.4, 110.0),
    ("Portland", "Por", "West", "Northwest", None, 118.0),
]


def team_rows():
    numbers = [82, 110.0]
    rest = [0.0, 98.0, 112.0]
    tail = [1.0, 0.1, 0.2, 0.3, 12.0, 0.0, 40, 42, 0.488, 0.5, 0.5, 0.0, "W1"]
    return [
        (name, code, conf, div, *numbers, oppg, *rest, deff, *tail)
        for name, code, conf, div, oppg, deff in TEAMS
    ]


def canonical_schema(fields):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(new, kind) for _, new, kind in fields])


@pytest.fixture(scope="session")
def season(spark):
    return Season(
        table(spark, canonical_schema(S.SHOTS), shot_rows()),
        table(spark, canonical_schema(S.PLAYERS + S.PLAYERS_OPTIONAL), PLAYERS),
        table(spark, canonical_schema(S.TEAMS), team_rows()),
    )
