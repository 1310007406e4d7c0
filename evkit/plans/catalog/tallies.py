"""Window queries: a day of events is a game, a user a player, a purchase a made attempt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evkit.operators.profile import minmax, value_range
from evkit.operators.windows import running_tallies
from evkit.plans.catalog.registry import Tables, query

CLOCK_SQL = """
    SELECT event_id, user_id, ts::DATE AS day, date_trunc('hour', ts) AS hour,
           CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS hit FROM events"""


def clocked_events(t: Tables) -> DataFrame:
    """The clock shows hours, so many events share a reading."""
    return t("events").select(
        "event_id",
        "user_id",
        F.col("ts").cast("date").alias("day"),
        F.date_trunc("hour", "ts").alias("hour"),
        (F.col("event_type") == "purchase").alias("made"),
    )


def tallied(t: Tables, mode: str) -> DataFrame:
    return running_tallies(
        clocked_events(t), "day", "user_id", ["-hour"], "made", ["event_id"], mode
    )


@query(
    "W1 W2 W3 W4",
    f"""
    SELECT event_id, seq,
           CASE WHEN alone = 1 THEN 0 ELSE taken - 1 END AS taken_before,
           CASE WHEN alone = 1 THEN 0 ELSE made - 1 END AS made_before
    FROM (SELECT event_id, row_number() OVER g AS seq,
                 count(user_id) OVER g AS taken, (sum(hit) OVER g)::BIGINT AS made,
                 count(user_id) OVER (PARTITION BY day, user_id ORDER BY hour DESC) AS alone
          FROM ({CLOCK_SQL})
          WINDOW g AS (PARTITION BY day ORDER BY hour DESC, event_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
)
def running_tallies_parity(t: Tables) -> DataFrame:
    return tallied(t, "parity").select("event_id", "seq", "taken_before", "made_before")


@query(
    "W1 W2 W4",
    f"""
    SELECT event_id, row_number() OVER (PARTITION BY day ORDER BY hour DESC, event_id) AS seq,
           count(*) OVER b AS taken_before, coalesce(sum(hit) OVER b, 0)::BIGINT AS made_before
    FROM ({CLOCK_SQL})
    WINDOW b AS (PARTITION BY day, user_id ORDER BY hour DESC, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def running_tallies_corrected(t: Tables) -> DataFrame:
    return tallied(t, "corrected").select("event_id", "seq", "taken_before", "made_before")


@query(
    "W6",
    f"""SELECT event_id, lag(hit) OVER (PARTITION BY day, user_id ORDER BY hour DESC, event_id)
               AS prev_outcome FROM ({CLOCK_SQL})""",
)
def previous_outcome(t: Tables) -> DataFrame:
    return tallied(t, "corrected").select("event_id", "prev_outcome")


@query(
    "W7",
    f"""
    SELECT event_id, round(sum(hit) OVER b / nullif(count(*) OVER b, 0)::DOUBLE, 6) AS rate_before
    FROM ({CLOCK_SQL})
    WINDOW b AS (PARTITION BY day, user_id ORDER BY hour DESC, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def rate_in_game(t: Tables) -> DataFrame:
    rated = tallied(t, "corrected")
    return rated.select("event_id", F.round("rate_before", 6).alias("rate_before"))


@query(
    "W5 D18",
    """SELECT s_suppkey, s_acctbal,
              round((s_acctbal - min(s_acctbal) OVER ())
                    / (max(s_acctbal) OVER () - min(s_acctbal) OVER () + 1e-9), 6) AS s_acctbal_norm
       FROM supplier""",
)
def normalised_balances(t: Tables) -> DataFrame:
    scaled = minmax(t("supplier").select("s_suppkey", "s_acctbal"), "s_acctbal")
    return scaled.withColumn("s_acctbal_norm", F.round("s_acctbal_norm", 6))


@query(
    "D18",
    """SELECT min(l_linenumber) AS l_linenumber_min, max(l_linenumber) AS l_linenumber_max,
              min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max FROM lineitem""",
)
def line_ranges(t: Tables) -> DataFrame:
    return value_range(t("lineitem"), ["l_linenumber", "l_quantity"])
