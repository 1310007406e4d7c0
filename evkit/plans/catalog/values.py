"""Expected value and over/under queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evkit.operators.conform import slice_rows
from evkit.operators.joins import denormalize
from evkit.operators.profile import argmax_row, rankings
from evkit.operators.value import (
    over_under_games,
    over_under_pivot,
    summarize_games,
)
from evkit.plans.catalog.registry import Tables, query
from evkit.plans.catalog.shared import (
    ATTEMPTS_SQL,
    EVENTS_SQL,
    attempts,
    conferences,
    order_owners,
    valued_lines,
)
from evkit.session import scratch_path, write_once
from evkit.sources import read_scored, replace_partitions, write_sorted


def games_sql(entity: str) -> str:
    return f"""
    SELECT game, {entity}, total_xp, total_pts,
           CASE WHEN total_pts > total_xp THEN 'yes' ELSE 'no' END AS over_flag,
           total_pts - total_xp AS delta,
           (total_pts - total_xp) / nullif(total_xp, 0) * 100 AS delta_pct
    FROM (SELECT game, {entity}, sum(xp) AS total_xp, sum(pts)::BIGINT AS total_pts
          FROM ({ATTEMPTS_SQL}) GROUP BY game, {entity})"""


def summary_sql(entity: str, min_games: int = 1) -> str:
    return f"""
    SELECT *, round_even(outperform / total::DOUBLE * 100, 4) AS outperform_pct,
           round_even(underperform / total::DOUBLE * 100, 4) AS underperform_pct,
           -round_even(underperform / total::DOUBLE * 100, 4) AS underperform_pct_neg
    FROM (SELECT {entity}, count(*) FILTER (over_flag = 'yes') AS outperform,
                 count(*) FILTER (over_flag = 'no') AS underperform, count(*) AS total,
                 round_even(avg(delta), 9) AS avg_delta,
                 round_even(avg(delta_pct), 9) AS avg_delta_pct
          FROM ({games_sql(entity)}) GROUP BY {entity} HAVING count(*) >= {min_games})"""


def team_games(t: Tables) -> DataFrame:
    """An order has one nation, so lines are summed by order before anything is joined."""
    games = over_under_games(valued_lines(t), "l_orderkey")
    return denormalize(games, [(order_owners(t), {"l_orderkey": "game"}, "")])


@query("C1 B16 B20 B21 B23 D3 D5 D7 D8 C4 B25", summary_sql("team"))
def over_under_by_nation(t: Tables) -> DataFrame:
    return summarize_games(team_games(t), "team", scale=4, delta_scale=9)


@query("D4 D9 B24 D8 D7", summary_sql("player", 10))
def over_under_by_customer_min_games(t: Tables) -> DataFrame:
    games = team_games(t)
    return summarize_games(games, "player", min_games=10, scale=4, delta_scale=9)


@query(
    "D3 B23 B24",
    f"""SELECT game, team, total_xp, total_pts, over_flag AS "over", delta,
               round(delta_pct, 6) AS delta_pct FROM ({games_sql("team")})""",
)
def game_totals(t: Tables) -> DataFrame:
    games = team_games(t).select(F.col("l_orderkey").alias("game"), "team", "total_xp", "total_pts", "over", "delta", "delta_pct")
    return games.withColumn("delta_pct", F.round("delta_pct", 6))


@query(
    "D6",
    f"""SELECT team, count(*) FILTER (over_flag = 'yes') AS outperform,
               count(*) FILTER (over_flag = 'no') AS underperform
        FROM ({games_sql("team")}) GROUP BY team""",
)
def over_under_by_pivot(t: Tables) -> DataFrame:
    return over_under_pivot(team_games(t), "team")


@query(
    "F4 D7 D8",
    f"""
    WITH s AS ({summary_sql("team")}),
    long AS (SELECT 'outperform_pct' AS metric, team, outperform_pct AS score FROM s
             UNION ALL SELECT 'underperform_pct', team, underperform_pct FROM s
             UNION ALL SELECT 'avg_delta', team, avg_delta FROM s
             UNION ALL SELECT 'avg_delta_pct', team, avg_delta_pct FROM s)
    SELECT metric, team, score,
           row_number() OVER (PARTITION BY metric ORDER BY score DESC, team) AS rank
    FROM long QUALIFY rank <= 5""",
)
def best_nations(t: Tables) -> DataFrame:
    summary = summarize_games(team_games(t), "team", scale=4, delta_scale=9)
    metrics = ["outperform_pct", "underperform_pct", "avg_delta", "avg_delta_pct"]
    return rankings(summary, "team", metrics, 5)


@query(
    "F4 D8",
    f"""
    WITH s AS ({summary_sql("player", 10)}),
    long AS (SELECT 'avg_delta' AS metric, player, avg_delta AS score FROM s
             UNION ALL SELECT 'avg_delta_pct', player, avg_delta_pct FROM s)
    SELECT metric, player, score,
           row_number() OVER (PARTITION BY metric ORDER BY score, player) AS rank
    FROM long QUALIFY rank <= 5""",
)
def worst_customers(t: Tables) -> DataFrame:
    games = team_games(t)
    summary = summarize_games(games, "player", min_games=10, scale=4, delta_scale=9)
    return rankings(summary, "player", ["avg_delta", "avg_delta_pct"], 5, desc=False)


@query(
    "D13",
    f"""SELECT team, avg_delta FROM ({summary_sql("team")})
        ORDER BY avg_delta DESC, team LIMIT 1""",
)
def nation_with_best_delta(t: Tables) -> DataFrame:
    summary = summarize_games(team_games(t), "team", scale=4, delta_scale=9)
    return argmax_row(summary.select("team", "avg_delta"), "avg_delta", "team")


@query(
    "D11 D15",
    f"""SELECT count(*) AS in_view, round(avg(outperform_pct), 4) AS outperform_pct,
               round(avg(underperform_pct), 4) AS underperform_pct
        FROM ({summary_sql("team")})""",
)
def nation_rate_averages(t: Tables) -> DataFrame:
    summary = summarize_games(team_games(t), "team", scale=4, delta_scale=9)
    return summary.agg(
        F.count(F.lit(1)).alias("in_view"),
        F.round(F.avg("outperform_pct"), 4).alias("outperform_pct"),
        F.round(F.avg("underperform_pct"), 4).alias("underperform_pct"),
    )


@query(
    "B8 B9 C6 D3 D5",
    f"""
    SELECT team, count(*) FILTER (over_flag = 'yes') AS outperform, count(*) AS total
    FROM ({games_sql("team")})
    JOIN nation ON team = n_name JOIN region ON n_regionkey = r_regionkey
    WHERE r_name IN ('ASIA', 'EUROPE') AND n_nationkey % 2 = 0 GROUP BY team""",
)
def region_slice(t: Tables) -> DataFrame:
    wanted = t("nation").filter("n_nationkey % 2 = 0").select("n_name")
    games = denormalize(team_games(t), [(conferences(t), {"team": "team"}, "")])
    chosen = slice_rows(games, conf=["ASIA", "EUROPE"], team=wanted)
    return summarize_games(chosen, "team").select("team", "outperform", "total")


@query(
    "B1 B18 B19 B20 B21",
    f"SELECT *, value * prob AS xp, value * label AS pts FROM ({EVENTS_SQL})",
)
def expected_value_rows(t: Tables) -> DataFrame:
    return valued_lines(t)


@query(
    "A3 C6",
    f"""SELECT conf, team, count(*) AS attempts, sum(xp) AS xp, sum(pts)::BIGINT AS pts
        FROM ({ATTEMPTS_SQL}) WHERE conf = 'ASIA' GROUP BY conf, team""",
)
def scored_round_trip(t: Tables) -> DataFrame:
    """Scored attempts written by conference and read back with a partition filter."""
    stored = write_once(attempts(t), "scored", ["conf"])
    return (
        stored.filter("conf = 'ASIA'")
        .groupBy("conf", "team")
        .agg(F.count(F.lit(1)).alias("attempts"), F.sum("xp").alias("xp"), F.sum("pts").alias("pts"))
    )


@query(
    "A3 C6",
    f"""SELECT conf, team, count(*) AS attempts, sum(xp) AS xp, sum(pts)::BIGINT AS pts
        FROM ({ATTEMPTS_SQL}) GROUP BY conf, team""",
)
def scored_partitions_replaced(t: Tables) -> DataFrame:
    """A first run that misses two of five attempts, then runs per conference that replace its partitions, one twice."""
    path = scratch_path(t.spark, "scored-partitions")
    scored = attempts(t).select("game", "team", "conf", "xp", "pts")
    replace_partitions(scored.filter("game % 5 > 1"), path, ["conf"])
    for confs in (["ASIA"], ["ASIA", "EUROPE"], ["AFRICA", "AMERICA", "MIDDLE EAST"]):
        replace_partitions(scored.filter(F.col("conf").isin(confs)), path, ["conf"])
    replace_partitions(scored.filter(F.col("conf").isNull()), path, ["conf"])
    return read_scored(t.spark, path).groupBy("conf", "team").agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("xp").alias("xp"), F.sum("pts").alias("pts"))


SORTED = ["o_orderpriority", "-o_totalprice", "o_orderkey"]


@query(
    "F1",
    """SELECT o_orderkey, o_orderpriority, o_totalprice,
              row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1 AS place FROM orders""",
)
def sorted_orders(t: Tables) -> DataFrame:
    """All orders in one order, mixed directions, as files; each row's place follows from its file and row."""
    path = scratch_path(t.spark, "sorted-orders")
    write_sorted(t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path, SORTED, files=7)
    rows = t.spark.read.parquet(path).select(
        "*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    # One row per file; names begin with the number of the range.
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select(F.col("file").alias("of"), F.coalesce(before, F.lit(0)).alias("ahead"))
    return rows.join(files, F.col("file") == F.col("of")).select(
        "o_orderkey", "o_orderpriority", "o_totalprice", (F.col("ahead") + F.col("row")).alias("place"))
