"""The exploratory tables and the dashboard tables, as named DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evkit.functions import contains_word
from evkit.operators.assoc import association_matrix, pearson, strong_associations
from evkit.operators.conform import drop_incomplete, scale_columns, slice_rows
from evkit.operators.entity import entity_profile, entity_vs_average
from evkit.operators.profile import (
    argmax_row,
    both_tails,
    deviation,
    distinct_values,
    frequency_table,
    kpis,
    rankings,
    top_k,
)
from evkit.operators.value import over_under
from evkit.plans.season import MIN_PLAYER_GAMES, Season, clean_players
from evkit.session import write_once
from evkit.sources import present, row_counts

# The columns that the exploratory tables look at.
PLAYER_METRICS = ["efg_pct", "ts_pct", "fg2_pct", "fg3_pct", "ortg"]
PCT_METRICS = ["efg_pct", "ts_pct", "fg2_pct", "fg3_pct"]
CORRELATED = [
    "gp", "mpg", "ppg", "ts_pct", "efg_pct", "fg2_pct", "fg3_pct", "ortg", "oppg", "deff",
]
NOMINAL = [
    "team_abbrv", "team_def", "position", "action_type", "shot_type", "basic_zone", "zone_name",
    "zone_range",
]
NUMERIC = ["shot_distance", "quarter", "shot_cat"]


def exploratory(features: DataFrame, season: Season, nulls: str = "pairwise") -> dict[str, DataFrame]:
    """Frequencies, rankings, correlations and associations.

    `features` is best read from files (see `run_season`): each table here is a job of its own.
    """
    players = clean_players(season.players)
    qualified = players.filter(F.col("qualified") == "Yes")
    shots, teams = season.shots, season.teams
    tables = {
        "player_counts": row_counts(players, qualified=F.col("qualified") == "Yes"),
        "event_type": frequency_table(features, "event_type"),
        "action_type": frequency_table(shots, "action_type", top=10),
        "zone_name": frequency_table(shots, "zone_name"),
        "basic_zone": frequency_table(shots, "basic_zone"),
        "zone_range": frequency_table(shots, "zone_range"),
        "quarter": frequency_table(shots, "quarter"),
        "shot_takers": frequency_table(features, "player_name", top=10),
    }
    volume = frequency_table(shots, "team_name")
    tables["teams_most_shots"] = top_k(volume, "count", 10, tiebreak=["value"])
    tables["teams_fewest_shots"] = top_k(volume, "count", 10, desc=False, tiebreak=["value"])
    for metric in ("oppg", "deff"):
        pair = teams.select("team", metric)
        tables[f"{metric}_best"] = top_k(pair, metric, 10, desc=False, tiebreak=["team"])
        tables[f"{metric}_worst"] = top_k(pair, metric, 10, tiebreak=["team"])
    for metric in PLAYER_METRICS:
        pair = qualified.select("full_name", metric)
        tables[f"{metric}_best"] = top_k(pair, metric, 10, tiebreak=["full_name"])
    matrix = association_matrix(features, NOMINAL, NUMERIC)
    tables["correlations"] = pearson(features, "shot_cat", CORRELATED, nulls)
    tables["associations"] = matrix
    tables["strong_associations"] = strong_associations(matrix, "shot_cat")
    return tables


def performance(
    scored: DataFrame,
    selection: Mapping[str, Sequence | DataFrame] | None = None,
    min_games: int = 10,
    k: int = 5,
) -> dict[str, DataFrame]:
    """Over/under tables of teams and players for a slice of the scored shots.

    The two summaries are written once; every other table starts from them.
    """
    chosen = slice_rows(scored, **(selection or {}))
    teams = write_once(over_under(chosen, "game_id", "team_abbrv"), "teams")
    players = write_once(
        over_under(chosen, "game_id", "full_name", min_games=min_games), "players"
    )
    tables = {"teams": teams, "players": players}
    for name, table, key in (("team", teams, "team_abbrv"), ("player", players, "full_name")):
        tables[f"{name}_best"] = rankings(
            table, key, ["outperform_pct", "underperform_pct", "avg_delta", "avg_delta_pct"], k
        )
        tables[f"{name}_worst"] = rankings(
            table, key, ["avg_delta", "avg_delta_pct"], k, desc=False
        )
        tables[f"{name}_top_delta"] = argmax_row(table, "avg_delta", key)
        tables[f"{name}_kpis"] = table.agg(
            F.count(F.lit(1)).alias("in_view"),
            F.avg("outperform_pct").alias("outperform_pct"),
            F.avg("underperform_pct").alias("underperform_pct"),
        )
    tables["players_scatter"] = top_k(players, "avg_delta", 30, tiebreak=["full_name"])
    return tables


def filter_options(scored: DataFrame) -> dict[str, DataFrame]:
    """Sorted values that the slice of `performance` can take."""
    return {c: distinct_values(scored, c) for c in present(scored, ["team_abbrv", "conf", "division"])}


def shooting(shots: DataFrame) -> dict[str, DataFrame]:
    """Attempt totals and the most frequent values; only columns that the shots have."""
    tables = {"kpis": kpis(shots, contains_word("event_type"), "zone_name", scale=1)}
    limits = {
        "event_type": None, "quarter": 6, "action_type": 10, "zone_name": None, "basic_zone": 8,
        "zone_range": 8,
    }
    for c in present(shots, list(limits)):
        tables[c] = frequency_table(shots, c, limits[c], 1, drop_null=True, rounding="half_even")
    return tables


def team_stats(season: Season) -> dict[str, DataFrame]:
    """Shot volume and defence of each team against the league mean."""
    counts = write_once(
        frequency_table(season.shots, "team_name", drop_null=True, scale=None), "volume"
    )
    volume = deviation(
        counts.select(F.col("value").alias("team_name"), "count"), ["count"], scale=0
    )
    defence = season.teams.select("team", "oppg", "deff").distinct()
    defence_dev = deviation(defence, ["oppg", "deff"], scale=1)
    return {
        "volume_most": top_k(counts, "count", 10, tiebreak=["value"]),
        "volume_fewest": top_k(counts, "count", 10, desc=False, tiebreak=["value"]),
        "volume_tails": both_tails(volume, "count_dev", 20, "team_name"),
        "oppg_tails": both_tails(defence_dev, "oppg_dev", 20, "team"),
        "deff_tails": both_tails(defence_dev, "deff_dev", 20, "team"),
        "oppg_best": top_k(defence.select("team", "oppg"), "oppg", 10, desc=False, tiebreak=["team"]),
        "deff_best": top_k(defence.select("team", "deff"), "deff", 10, desc=False, tiebreak=["team"]),
        "defence": defence_dev,
    }


def player_stats(
    season: Season, player_over_under: DataFrame, min_player_games: int = MIN_PLAYER_GAMES
) -> dict[str, DataFrame]:
    """Profiles of all qualified players at once, and the leaders per metric."""
    players = drop_incomplete(season.players).filter(F.col("gp") >= min_player_games)
    metrics = present(players, PLAYER_METRICS)
    pct = [m for m in metrics if m in PCT_METRICS]
    scaled = scale_columns(players.select("full_name", *metrics), pct)
    tables = {
        "profiles": entity_profile(
            players, season.shots, player_over_under, "full_name", fact_key="player_name"
        ),
        "against_average": entity_vs_average(players, "full_name", metrics, pct, scale=1),
        "shot_takers": frequency_table(season.shots, "player_name", top=10, drop_null=True),
        "efficiency": top_k(players, "efg_pct", 30, tiebreak=["full_name"]),
    }
    for m in metrics:
        tables[f"{m}_best"] = top_k(scaled.select("full_name", m), m, 10, tiebreak=["full_name"])
    return tables
