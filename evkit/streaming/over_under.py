"""Over/under on a growing log of events, by Structured Streaming (optional part of the inventory, phase 6).

Two forms, both from a folder of files that grows:

* `stream_games` keeps sums per (game, entity) that add up: each micro-batch writes its own sums into a folder of its
  own, replacing what an earlier try of the same batch left there, and `read_games` adds them up. No state is kept
  between batches, so any number of games, and events of any age, cost nothing but their rows.
* `stream_windows` sums per (window of time, entity) with a watermark: a window is written once, when no event of it
  can come any more; its state is then dropped. Later events of it are left out.

Both run until the files that are there are used up (`availableNow`), and go on from there in the next run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evkit.functions import over_flag

# Files per micro-batch.
FILES = 1000


def _sums(events: DataFrame, keys: Sequence, xp: str, pts: str) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.coalesce(F.sum(xp), F.lit(0.0)).alias("total_xp"), F.coalesce(F.sum(pts), F.lit(0)).alias("total_pts"))


def _with_flags(sums: DataFrame) -> DataFrame:
    delta = F.col("total_pts") - F.col("total_xp")
    return sums.withColumns({
        "over": over_flag("total_pts", "total_xp"), "delta": delta,
        "delta_pct": F.try_divide(delta, F.col("total_xp")) * F.lit(100.0),
    })


def _run(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_games(events: DataFrame, sink: str, checkpoint: str, game: str, entity: str, xp: str = "xp",
                 pts: str = "pts") -> None:
    """Add what is new in the streaming table `events` to the sums below `sink` (see `read_games`)."""

    def add(batch: DataFrame, number: int) -> None:
        _sums(batch, [game, entity], xp, pts).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    _run(events.select(game, entity, xp, pts).writeStream.foreachBatch(add), checkpoint)


def read_games(spark: SparkSession, sink: str, game: str, entity: str) -> DataFrame:
    """Sums and flags per (game, entity) over all batches so far, as `over_under_games` gives them."""
    parts = spark.read.parquet(sink)
    return _with_flags(_sums(parts, [game, entity], "total_xp", "total_pts"))


def stream_windows(events: DataFrame, sink: str, checkpoint: str, at: str, entity: str, width: str = "1 day",
                   late: str = "1 day", xp: str = "xp", pts: str = "pts") -> None:
    """Add the windows that the new events close to the table below `sink` (see `closed_windows`).

    `at` is a timestamp; `late` is how long events may come after later ones.
    """
    timed = events.select(F.col(at).alias("at"), entity, xp, pts).withWatermark("at", late)
    sums = _sums(timed, [F.window("at", width).alias("window"), entity], xp, pts)
    flat = sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), entity, "total_xp", "total_pts")
    _run(flat.writeStream.format("parquet").outputMode("append").option("path", sink), checkpoint)


def closed_windows(spark: SparkSession, sink: str) -> DataFrame:
    """Sums and flags per (start, end, entity) of the windows closed so far."""
    return _with_flags(spark.read.parquet(sink))


def read_log(spark: SparkSession, folder: str, schema, files: int = FILES) -> DataFrame:
    """A folder of Parquet files as a streaming table; files that are added later are read later."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
