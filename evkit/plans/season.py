"""A season of shots: clean, join, tally, model, and score (the model job end to end)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evkit.functions import (
    flag_to_label,
    opponent_of,
    pct_text,
    point_value_from_type,
    point_value_from_zone,
    text_to_label,
)
from evkit.operators import conform
from evkit.operators.boosting import Boosted, fit_boosted
from evkit.operators.evaluate import evaluate, rank_auc
from evkit.operators.joins import denormalize, lookup_mean, require_unique, unmatched_keys
from evkit.operators.model import (
    load_model,
    save_model,
    score,
    score_scenarios,
    stratified_split,
    temporal_split,
    train_model,
)
from evkit.operators.profile import facet_counts, top_k
from evkit.operators.value import expected_value, over_under
from evkit.operators.windows import running_tallies
from evkit.session import write_once
from evkit.sources import present, read_table
from evkit.sources import schemas as S

# Team names that differ between the shot file and the team file.
TEAM_NAMES = [
    ("Los Angeles", "Lakers", "LA Lakers"),
    ("Los Angeles", "Clippers", "LA Clippers"),
    ("Portland Trail", "Blazers", "Portland"),
]
# Team codes that differ likewise.
TEAM_CODES = {"BKN": "BRO"}
# Games a player needs, and the last game of the training part.
MIN_PLAYER_GAMES = 50
LAST_TRAINING_GAME = 22100861

CLOCK = ["quarter", "-mins_left", "-secs_left"]
# Attempts on one clock keep one order when all of these are compared.
CLOCK_TIES = [
    "player_id", "shot_made", "action_type", "shot_type", "basic_zone", "zone_name", "zone_range",
    "shot_distance",
]
# The model inputs.
MODEL_CATEGORIES = [
    "position", "action_type", "shot_type", "basic_zone", "zone_name", "zone_range",
]
MODEL_NUMBERS = ["ts_pct", "efg_pct", "fg2_pct", "ortg"]
TALLY_NUMBERS = ["taken_before", "made_before"]
SITUATION_CATEGORIES = ["basic_zone", "zone_range", "zone_name", "action_type"]
SITUATION_NUMBERS = ["quarter"]
TENDENCIES = {"fg2_pct": "player_2p_pct", "fg3_pct": "player_3p_pct"}


class Season(NamedTuple):
    shots: DataFrame
    players: DataFrame
    teams: DataFrame


class SituationModel(NamedTuple):
    """Boosted trees on the shot situation, with the hold-out area under the curve."""

    model: Boosted
    auc: DataFrame
    base_rate: DataFrame


def load_table(
    spark: SparkSession,
    path: str,
    fields: Sequence[S.Field],
    optional: Sequence[S.Field] = (),
    fmt: str = "csv",
    keep_others: bool = False,
) -> DataFrame:
    """One file under canonical column names."""
    fields, optional = list(fields), list(optional)
    names = S.canonical(fields + optional)
    return read_table(
        spark, path, S.struct(fields), fmt, names, S.struct(optional), keep_others=keep_others
    )


def load_season(
    spark: SparkSession, shots: str, players: str, teams: str, fmt: str = "csv"
) -> Season:
    """The three files under canonical column names.

    Player rows keep all columns of the file, because a null in any of them drops the row.
    """
    return Season(
        load_table(spark, shots, S.SHOTS, fmt=fmt),
        load_table(spark, players, S.PLAYERS, S.PLAYERS_OPTIONAL, fmt, keep_others=True),
        load_table(spark, teams, S.TEAMS, fmt=fmt),
    )


def load_scored(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scored shots of an earlier run, conference and division where the file has them (A2)."""
    return load_table(spark, path, S.SCORED, S.SCORED_OPTIONAL, fmt)


def clean_teams(teams: DataFrame) -> DataFrame:
    return teams.withColumn("team_abbrv", F.upper("team_abbrv"))


def clean_players(players: DataFrame, min_games: int = MIN_PLAYER_GAMES) -> DataFrame:
    """Complete player rows with upper-case team codes and the `qualified` flag."""
    complete = conform.drop_incomplete(players.withColumn("team", F.upper("team")))
    return conform.add_ratio(conform.qualify(complete, "gp", min_games), "ppg", "mpg", "ppg_norm")


def clean_shots(
    shots: DataFrame, codes: Mapping[str, str] = TEAM_CODES, mode: str = "corrected"
) -> DataFrame:
    """Shots with the team name of the team file and recoded sides.

    mode="parity" recodes the away side only, as the original job does; its home games of a
    recoded team then miss the defence columns.
    """
    named = conform.split_name(shots, "team_name", "_head", "_tail")
    team = F.col("_head")
    for head, tail, name in TEAM_NAMES:
        team = F.when((F.col("_head") == head) & (F.col("_tail") == tail), name).otherwise(team)
    sides = ["away_team"] if mode == "parity" else ["away_team", "home_team"]
    return (
        named.withColumn("team", team)
        .drop("_head", "_tail")
        .withColumns({c: conform.recode(c, codes) for c in sides})
    )


def build_master(
    season: Season,
    codes: Mapping[str, str] = TEAM_CODES,
    min_games: int = MIN_PLAYER_GAMES,
    mode: str = "corrected",
) -> DataFrame:
    """Shots with shooter and defence columns: one row per shot."""
    teams = require_unique(clean_teams(season.teams), ["team"], "teams")
    players = clean_players(season.players, min_games)
    shots = denormalize(
        clean_shots(season.shots, codes, mode),
        [(teams.select("team", "team_abbrv"), {"team": "team"}, "")],
    )
    shots = shots.withColumns(
        {
            "team_def": opponent_of("team_abbrv", "home_team", "away_team"),
            "shot_cat": flag_to_label("shot_made"),
        }
    )
    player_columns = [new for _, new, _ in S.PLAYERS]
    shooter = players.select(
        *player_columns, "qualified", F.col("full_name").alias("_name")
    )
    defence = teams.select("team_abbrv", "oppg", "deff")
    return denormalize(
        shots,
        [
            (shooter, {"player_name": "_name", "team_abbrv": "team"}, ""),
            (defence, {"team_def": "team_abbrv"}, ""),
        ],
    )


def unmatched_teams(season: Season, codes: Mapping[str, str] = TEAM_CODES) -> DataFrame:
    """Side codes of the shot file that the team file does not know, with their row counts."""
    shots = clean_shots(season.shots, codes)
    sides = shots.select(F.explode(F.array("home_team", "away_team")).alias("code"))
    return unmatched_keys(sides, clean_teams(season.teams), {"code": "team_abbrv"})


def build_features(master: DataFrame, mode: str = "corrected", **kwargs) -> DataFrame:
    """Tallies, then the qualified shooters.

    The filter stays above the tallies: attempts of all shooters count in them.
    """
    tallied = running_tallies(
        master, "game_id", "player_id", CLOCK, "shot_made", present(master, CLOCK_TIES), mode, **kwargs
    )
    return tallied.filter(F.col("qualified") == "Yes")


def fit_make_model(
    features: DataFrame,
    cutoff: int = LAST_TRAINING_GAME,
    kind: str = "lr",
    with_tallies: bool = False,
    **params: object,
) -> tuple[PipelineModel | Boosted, DataFrame]:
    """(fitted model, hold-out rows): games up to `cutoff` train, later ones are held out."""
    train, test = temporal_split(features, "game_id", cutoff)
    numbers = MODEL_NUMBERS + (TALLY_NUMBERS if with_tallies else [])
    return train_model(kind, train, MODEL_CATEGORIES, numbers, "shot_cat", **params), test


def score_shots(model: PipelineModel | Boosted, shots: DataFrame) -> DataFrame:
    """Scored shots: the table that the reports read."""
    scored = score(model, shots, "prob_made").withColumn(
        "shot_pt", point_value_from_type("shot_type")
    )
    valued = expected_value(scored, "shot_pt", "prob_made", "shot_cat")
    return valued.select(*[new for _, new, _ in S.SCORED])


def add_conference(scored: DataFrame, teams: DataFrame) -> DataFrame:
    """Conference and division of the shooting team."""
    side = clean_teams(teams).select("team_abbrv", "conf", "division")
    return denormalize(scored, [(side, {"team_abbrv": "team_abbrv"}, "")])


def team_report(scored: DataFrame) -> DataFrame:
    """Games over and under expectation per team, shares to whole percents and as text."""
    summary = over_under(
        scored, "game_id", "team_abbrv", rounding="half_up", drop_null=False
    )
    return summary.select(
        "team_abbrv",
        "outperform",
        "underperform",
        "outperform_pct",
        "underperform_pct",
        pct_text("outperform_pct").alias("outperform_text"),
        pct_text("underperform_pct").alias("underperform_text"),
    )


def best_and_worst(report: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    """Teams most often over and most often under; ranked on the numbers, not on the text."""
    return {
        "outperform": top_k(report, "outperform_pct", k, tiebreak=["team_abbrv"]),
        "underperform": top_k(report, "underperform_pct", k, tiebreak=["team_abbrv"]),
    }


def run_season(
    season: Season,
    cutoff: int = LAST_TRAINING_GAME,
    codes: Mapping[str, str] = TEAM_CODES,
    mode: str = "corrected",
    kind: str = "lr",
    min_games: int = MIN_PLAYER_GAMES,
) -> dict[str, DataFrame]:
    """The whole job: features, scored hold-out shots, team report and metrics.

    The joined shots and the scored shots are written once; everything after starts from them.
    """
    master = write_once(build_master(season, codes, min_games, mode), "master")
    features = write_once(build_features(master, mode), "features")
    model, test = fit_make_model(features, cutoff, kind)
    scored = write_once(score_shots(model, test), "scored")
    report = team_report(scored)
    best = best_and_worst(report)
    return {
        "master": master,
        "features": features,
        "scored": scored,
        "team_report": report,
        "top_outperform": best["outperform"],
        "top_underperform": best["underperform"],
        "metrics": evaluate(scored, "shot_cat", "prob_made", "prediction"),
    }


def add_tendencies(df: DataFrame, players: DataFrame) -> DataFrame:
    """Two- and three-point rates of the named shooter; the league average for other names.

    Works on shots and on scenarios alike: a scenario for the league average names nobody.
    """
    complete = conform.drop_incomplete(players)
    return lookup_mean(df, complete, {"player_name": "full_name"}, TENDENCIES)


def situation_features(shots: DataFrame, players: DataFrame) -> DataFrame:
    """Shots with the label from the event text and the shooter's tendencies."""
    return add_tendencies(shots.withColumn("made", text_to_label("event_type")), players)


def fit_situation_model(
    shots: DataFrame,
    players: DataFrame,
    row_id: str,
    frac: float = 0.2,
    mode: str = "hash",
    **params: object,
) -> SituationModel:
    """Boosted trees on the situation: measured on a stratified hold-out, then fitted on all rows.

    Only the wanted columns that the shots have are used (B30). A tenth of the training rows, by
    hash of the row id, decides when boosting stops.
    """
    cats = present(shots, SITUATION_CATEGORIES)
    nums = present(shots, SITUATION_NUMBERS) + list(TENDENCIES.values())
    rows = situation_features(shots, players)
    rows = conform.drop_incomplete(rows, cats + nums).select(row_id, *cats, *nums, "made")
    rows = write_once(rows, "situations")
    watched = F.pmod(F.xxhash64(F.col(row_id), F.lit("stop")), F.lit(10)) == 0
    train, test = stratified_split(rows, row_id, "made", frac, mode=mode)
    held_out = score(fit_boosted(train, cats, nums, "made", watched, **params), test)
    return SituationModel(
        fit_boosted(rows, cats, nums, "made", watched, **params),
        rank_auc(held_out, "made", "prob"),
        rows.agg(F.avg("made").alias("base_rate")),
    )


def keep_situation_model(fitted: SituationModel, path: str) -> None:
    """Save the model, its base rate and its area under the curve below `path`, on shared storage."""
    save_model(fitted.model, fitted.base_rate, path)
    fitted.auc.coalesce(1).write.mode("overwrite").parquet(f"{path}/auc")


def kept_situation_model(spark: SparkSession, path: str) -> SituationModel:
    """A kept model, ready to score scenarios in any session, without a fit."""
    model, rate = load_model(spark, path)
    base = spark.createDataFrame([(rate,)], "base_rate double")
    return SituationModel(model, spark.read.parquet(f"{path}/auc"), base)


def score_situations(fitted: SituationModel, scenarios: DataFrame) -> DataFrame:
    """Probability, expected points and lift for any number of situations at once."""
    with_value = scenarios.withColumn("shot_pt", point_value_from_zone("basic_zone"))
    return score_scenarios(fitted.model, with_value, "shot_pt", fitted.base_rate.scalar())


def situation_choices(shots: DataFrame, cols: Sequence[str] = SITUATION_CATEGORIES) -> DataFrame:
    """Every combination of situation values that occurs, level by level."""
    return facet_counts(shots, present(shots, cols))
