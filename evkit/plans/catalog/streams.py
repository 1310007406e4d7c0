"""Over/under on the event log, read as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evkit.plans.catalog.registry import SCHEMAS, Tables, query
from evkit.session import scratch_path
from evkit.streaming import closed_windows, read_games, read_log, stream_games, stream_windows

# An event is worth its value in expectation, and 50 if it is a purchase.
LOG_SQL = """SELECT user_id, event_type, ts, value AS xp, CASE WHEN event_type = 'purchase' THEN 50 ELSE 0 END AS pts FROM events"""


# Times without a zone as UTC and back, whatever the zone of the session.
AS_UTC = "timestampadd(MICROSECOND, timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', ts), TIMESTAMP'1970-01-01 00:00:00Z')"
FROM_UTC = "timestampadd(MICROSECOND, unix_micros({0}), TIMESTAMP_NTZ'1970-01-01')"


def event_log(t: Tables) -> DataFrame:
    # As a pattern, the path may be a folder of files or, as in the small sets, one file.
    log = read_log(t.spark, f"{t.folder}/events.parque[t]", SCHEMAS["events"])
    return log.select("user_id", "event_type", F.expr(AS_UTC).alias("ts"), F.col("value").alias("xp"),
                      F.when(F.col("event_type") == "purchase", 50).otherwise(0).alias("pts"))


def rounded_sums(df: DataFrame) -> DataFrame:
    return df.withColumn("total_xp", F.round("total_xp", 6)).drop("delta", "delta_pct")


@query(
    "D3 D4 B23",
    f"""SELECT user_id, event_type, round(sum(xp), 6) AS total_xp, sum(pts)::BIGINT AS total_pts,
               CASE WHEN sum(pts) > sum(xp) THEN 'yes' ELSE 'no' END AS "over" FROM ({LOG_SQL}) GROUP BY user_id, event_type""",
)
def streamed_games(t: Tables) -> DataFrame:
    sink, checkpoint = scratch_path(t.spark, "streamed-games"), scratch_path(t.spark, "stream-state")
    stream_games(event_log(t), sink, checkpoint, "user_id", "event_type")
    return rounded_sums(read_games(t.spark, sink, "user_id", "event_type"))


@query(
    "D3 B23",
    f"""SELECT start, start + INTERVAL 1 DAY AS "end", event_type, round(sum(xp), 6) AS total_xp, sum(pts)::BIGINT AS total_pts,
               CASE WHEN sum(pts) > sum(xp) THEN 'yes' ELSE 'no' END AS "over"
        FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, xp, pts FROM ({LOG_SQL}))
        WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY start, event_type""",
)
def streamed_days(t: Tables) -> DataFrame:
    """Days per type of event, as far as the watermark of one day has closed them."""
    sink, checkpoint = scratch_path(t.spark, "streamed-days"), scratch_path(t.spark, "stream-state")
    stream_windows(event_log(t), sink, checkpoint, "ts", "event_type")
    days = rounded_sums(closed_windows(t.spark, sink))
    return days.withColumns({c: F.expr(FROM_UTC.format(f"`{c}`")) for c in ("start", "end")})
