"""Expected value and over/under roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evkit.functions import as_col, over_flag, rounded


def expected_value(
    scored: DataFrame, value: str | Column, prob: str | Column, label: str | Column
) -> DataFrame:
    """Add `xp` = value x probability and `pts` = value x label."""
    value = as_col(value)
    return scored.withColumns({"xp": value * as_col(prob), "pts": value * as_col(label)})


def over_under_games(
    ev: DataFrame, game: str, entity: str | None = None, xp: str = "xp", pts: str = "pts"
) -> DataFrame:
    """Per (game, entity): sums, `over` yes/no, `delta` and `delta_pct`.

    `delta_pct` is null where nothing was expected. Where a game has one entity, leave `entity`
    out and join the entity to the sums: fewer rows meet the joins.
    """
    sums = ev.groupBy(game, *([entity] if entity else [])).agg(
        F.coalesce(F.sum(xp), F.lit(0.0)).alias("total_xp"),
        F.coalesce(F.sum(pts), F.lit(0)).alias("total_pts"),
    )
    delta = F.col("total_pts") - F.col("total_xp")
    return sums.withColumns(
        {
            "over": over_flag("total_pts", "total_xp"),
            "delta": delta,
            "delta_pct": F.try_divide(delta, F.col("total_xp")) * F.lit(100.0),
        }
    )


def _with_rates(df: DataFrame, scale: int | None, rounding: str) -> DataFrame:
    df = df.withColumn("total", F.col("outperform") + F.col("underperform"))
    total = F.col("total").cast("double")
    return df.withColumns(
        {
            f"{side}_pct": rounded(F.col(side).cast("double") / total * F.lit(100.0), scale, rounding)
            for side in ("outperform", "underperform")
        }
    )


def summarize_games(
    games: DataFrame,
    entity: str,
    min_games: int = 1,
    scale: int | None = 0,
    delta_scale: int | None = 1,
    rounding: str = "half_even",
) -> DataFrame:
    """Per entity: games over and under, their shares, mean deltas.

    One aggregation gives counts and means, so nothing is joined back.
    """
    counted = games.groupBy(entity).agg(
        F.count_if(F.col("over") == "yes").alias("outperform"),
        F.count_if(F.col("over") == "no").alias("underperform"),
        rounded(F.avg("delta"), delta_scale, rounding).alias("avg_delta"),
        rounded(F.avg("delta_pct"), delta_scale, rounding).alias("avg_delta_pct"),
    )
    rated = _with_rates(counted, scale, rounding).filter(F.col("total") >= min_games)
    return rated.select(
        entity,
        "outperform",
        "underperform",
        "total",
        "outperform_pct",
        "underperform_pct",
        (-F.col("underperform_pct")).alias("underperform_pct_neg"),
        "avg_delta",
        "avg_delta_pct",
    )


def over_under(
    ev: DataFrame,
    game: str,
    entity: str,
    min_games: int = 1,
    scale: int | None = 0,
    delta_scale: int | None = 1,
    rounding: str = "half_even",
    drop_null: bool = True,
) -> DataFrame:
    """`summarize_games` of `over_under_games`.

    `drop_null` leaves out events without a game or entity, the data-frame habit; with
    `drop_null=False` they form a group of their own, the SQL habit.
    """
    if drop_null:
        ev = ev.filter(F.col(game).isNotNull() & F.col(entity).isNotNull())
    games = over_under_games(ev, game, entity)
    return summarize_games(games, entity, min_games, scale, delta_scale, rounding)


def over_under_pivot(games: DataFrame, entity: str) -> DataFrame:
    """Games over and under per entity as a pivot; both columns always exist."""
    pivoted = games.groupBy(entity).pivot("over", ["yes", "no"]).agg(F.count(F.lit(1)))
    return pivoted.select(
        entity,
        F.coalesce("yes", F.lit(0)).alias("outperform"),
        F.coalesce("no", F.lit(0)).alias("underperform"),
    )
