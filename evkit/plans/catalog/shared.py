"""Stand-ins for the season tables, built from the test tables.

A line item is an attempt, its order the game, the customer the player, the customer's nation the
team and the region the conference. The probability is quantity / 64: a binary fraction, so that
sums are exact in any order and the comparison of actual with expected is never a rounding matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evkit.operators.joins import denormalize
from evkit.operators.value import expected_value
from evkit.plans.catalog.registry import Tables

# The same events for the SQL side.
EVENTS_SQL = """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CASE WHEN l_linestatus = 'O' THEN 3 ELSE 2 END AS value,
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
           l_quantity / 64::DOUBLE AS prob
    FROM lineitem"""

ATTEMPTS_SQL = f"""
    SELECT e.l_orderkey AS game, n_name AS team, c_custkey AS player, r_name AS conf,
           value * prob AS xp, value * label AS pts
    FROM ({EVENTS_SQL}) e
    LEFT JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey"""


def valued_lines(t: Tables) -> DataFrame:
    """Line items with value, label, probability, xp and pts."""
    lines = t("lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        F.when(F.col("l_linestatus") == "O", 3).otherwise(2).alias("value"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        (F.col("l_quantity") / F.lit(64.0)).alias("prob"),
    )
    return expected_value(lines, "value", "prob", "label")


def order_owners(t: Tables) -> DataFrame:
    """One row per order: game, player, team."""
    owners = denormalize(
        t("orders").select("o_orderkey", "o_custkey"),
        [
            (t("customer").select("c_custkey", "c_nationkey"), {"o_custkey": "c_custkey"}, ""),
            (t("nation").select("n_nationkey", "n_name"), {"c_nationkey": "n_nationkey"}, ""),
        ],
    )
    return owners.select(
        F.col("o_orderkey").alias("game"),
        F.col("o_custkey").alias("player"),
        F.col("n_name").alias("team"),
    )


def conferences(t: Tables) -> DataFrame:
    """One row per team: its conference."""
    regions = denormalize(t("nation"), [(t("region"), {"n_regionkey": "r_regionkey"}, "")])
    return regions.select(F.col("n_name").alias("team"), F.col("r_name").alias("conf"))


def attempts(t: Tables) -> DataFrame:
    """Scored attempts with game, player, team and conf."""
    lines = valued_lines(t).select(F.col("l_orderkey").alias("line_game"), "xp", "pts")
    owned = denormalize(lines, [(order_owners(t), {"line_game": "game"}, "")])
    return denormalize(owned, [(conferences(t), {"team": "team"}, "")]).withColumnRenamed(
        "line_game", "game"
    )


def judged_documents(t: Tables) -> DataFrame:
    """Documents with labels: `quality` is the label, text length the score."""
    docs = t("documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(t("labels"), "doc_id")
