"""Input schemas: each field is (name in the file, canonical name, type).

Fixed values: the column names must equal those of the season files.
"""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, LONG = T.StringType(), T.IntegerType(), T.LongType()
DOUBLE, BOOLEAN = T.DoubleType(), T.BooleanType()

Field = tuple[str, str, T.DataType]

SHOTS: list[Field] = [
    ("GAME_ID", "game_id", LONG),
    ("PLAYER_ID", "player_id", LONG),
    ("PLAYER_NAME", "player_name", STRING),
    ("TEAM_NAME", "team_name", STRING),
    ("HOME_TEAM", "home_team", STRING),
    ("AWAY_TEAM", "away_team", STRING),
    ("POSITION", "position", STRING),
    ("EVENT_TYPE", "event_type", STRING),
    ("SHOT_MADE", "shot_made", BOOLEAN),
    ("ACTION_TYPE", "action_type", STRING),
    ("SHOT_TYPE", "shot_type", STRING),
    ("BASIC_ZONE", "basic_zone", STRING),
    ("ZONE_NAME", "zone_name", STRING),
    ("ZONE_RANGE", "zone_range", STRING),
    ("SHOT_DISTANCE", "shot_distance", DOUBLE),
    ("QUARTER", "quarter", INT),
    ("MINS_LEFT", "mins_left", INT),
    ("SECS_LEFT", "secs_left", INT),
]

PLAYERS: list[Field] = [
    ("FULL NAME", "full_name", STRING),
    ("TEAM", "team", STRING),
    ("POS", "pos", STRING),
    ("GP", "gp", INT),
    ("MPG", "mpg", DOUBLE),
    ("PPG", "ppg", DOUBLE),
    ("TS%", "ts_pct", DOUBLE),
    ("eFG%", "efg_pct", DOUBLE),
    ("2P%", "fg2_pct", DOUBLE),
    ("3P%", "fg3_pct", DOUBLE),
    ("ORTG", "ortg", DOUBLE),
]

# Read only where the file has them.
PLAYERS_OPTIONAL: list[Field] = [
    ("DRTG", "drtg", DOUBLE),
    ("USG%", "usg_pct", DOUBLE),
]

TEAMS: list[Field] = [
    ("TEAM", "team", STRING),
    ("TEAM_ABBRV", "team_abbrv", STRING),
    ("CONF", "conf", STRING),
    ("DIVISION", "division", STRING),
    ("GP", "gp", INT),
    ("PPG", "ppg", DOUBLE),
    ("oPPG", "oppg", DOUBLE),
    ("pDIFF", "pdiff", DOUBLE),
    ("PACE", "pace", DOUBLE),
    ("oEFF", "oeff", DOUBLE),
    ("dEFF", "deff", DOUBLE),
    ("eDIFF", "ediff", DOUBLE),
    ("SOS", "sos", DOUBLE),
    ("rSOS", "rsos", DOUBLE),
    ("SAR", "sar", DOUBLE),
    ("CONS", "cons", DOUBLE),
    ("A4F", "a4f", DOUBLE),
    ("W", "w", INT),
    ("L", "l", INT),
    ("WIN%", "win_pct", DOUBLE),
    ("eWIN%", "ewin_pct", DOUBLE),
    ("pWIN%", "pwin_pct", DOUBLE),
    ("ACH", "ach", DOUBLE),
    ("STRK", "strk", STRING),
]

SCORED: list[Field] = [
    ("FULL NAME", "full_name", STRING),
    ("GAME_ID", "game_id", LONG),
    ("TEAM_ABBRV", "team_abbrv", STRING),
    ("SHOT_CAT", "shot_cat", INT),
    ("prediction", "prediction", DOUBLE),
    ("shot_pt", "shot_pt", INT),
    ("prob_made", "prob_made", DOUBLE),
    ("xP", "xp", DOUBLE),
    ("pts", "pts", INT),
]

SCORED_OPTIONAL: list[Field] = [
    ("CONF", "conf", STRING),
    ("DIVISION", "division", STRING),
]


def struct(fields: list[Field]) -> T.StructType:
    """The fields as a schema under their file names."""
    return T.StructType([T.StructField(name, kind) for name, _, kind in fields])


def canonical(fields: list[Field]) -> dict[str, str]:
    """File name -> canonical name."""
    return {name: new for name, new, _ in fields}
