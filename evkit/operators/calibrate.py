"""Calibration of probabilities: reliability by bins, and isotonic regression.

The isotonic fit pools adjacent violators over distinct scores. Pools of any size come from small steps: scores are
ranked and cut into blocks, each block is pooled in one task, and what is left is ranked and cut again, at other
places. Pooling adjacent violators gives the same pools in any order of steps, so once neither cut changes anything
the fit is the global one. A task never sees more than a block.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evkit.operators.ranks import ranked
from evkit.session import write_once

POOLS_PER_TASK = 100_000
# Parts of the range of scores, by which scores find their pool.
SLOTS = 4096
POOL = "low double, high double, rows long, hits long"


def reliability(scored: DataFrame, label: str, prob: str, bins: int = 10) -> DataFrame:
    """`bin` (from 0), `rows`, `mean_prob`, `rate` and `gap` (rate less probability) per bin of equal width.

    Rows without a label or probability are left out; bins without rows do not appear.
    """
    place = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    known = scored.filter(F.col(label).isNotNull() & F.col(prob).isNotNull())
    found = known.groupBy(F.greatest(place, F.lit(0)).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(prob).alias("mean_prob"), F.avg(F.col(label).cast("double")).alias("rate"))
    return found.withColumn("gap", F.col("rate") - F.col("mean_prob"))


def calibration_error(scored: DataFrame, label: str, prob: str, bins: int = 10) -> DataFrame:
    """One row: the mean absolute gap, weighted by rows, and the largest one."""
    found = reliability(scored, label, prob, bins)
    size = F.abs("gap")
    return found.agg(F.try_divide(F.sum(size * F.col("rows")), F.sum("rows").cast("double")).alias("expected_error"),
                     F.max(size).alias("largest_error"))


def _pool(frame: pd.DataFrame) -> pd.DataFrame:
    """Adjacent pools whose rates do not rise become one; counts are whole numbers, so no rounding decides."""
    done: list[list] = []
    for low, high, rows, hits in frame.sort_values("low")[["low", "high", "rows", "hits"]].itertuples(index=False):
        done.append([low, high, int(rows), int(hits)])
        while len(done) > 1 and done[-2][3] * done[-1][2] >= done[-1][3] * done[-2][2]:
            _, high, rows, hits = done.pop()
            done[-1][1] = high
            done[-1][2] += rows
            done[-1][3] += hits
    return pd.DataFrame(done, columns=["low", "high", "rows", "hits"])


def isotonic_fit(scored: DataFrame, label: str, prob: str, pools_per_task: int = POOLS_PER_TASK) -> DataFrame:
    """`low`, `high`, `rows`, `hits`, `rate` of the pools of an isotonic fit of a 0/1 label, rates rising.

    `low` and `high` are the least and the greatest score of a pool. Rows without a label or probability are left out.
    """
    known = scored.filter(F.col(label).isNotNull() & F.col(prob).isNotNull())
    score = F.col(prob).cast("double")
    pools = known.groupBy(score.alias("low")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("hits"))
    pools = write_once(pools.select("low", F.col("low").alias("high"), "rows", "hits"), "scores")
    count, unchanged, offset = pools.count(), 0, 0
    while unchanged < 2 and count:
        whole = count <= pools_per_task
        block = F.lit(0) if whole else F.floor((F.col("place") + offset) / pools_per_task)
        placed = pools.withColumn("place", F.lit(0)) if whole else ranked(pools, [], ["low"], "place")
        pooled = placed.groupBy(block.cast("long").alias("block")).applyInPandas(_pool, POOL)
        pools = write_once(pooled, "pools")
        before, count = count, pools.count()
        unchanged = 2 if whole else unchanged + 1 if count == before else 0
        offset = 0 if offset else pools_per_task // 2
    return pools.withColumn("rate", F.col("hits").cast("double") / F.col("rows"))


def isotonic_score(df: DataFrame, pools: DataFrame, prob: str, out: str = "calibrated") -> DataFrame:
    """`df` plus the rate of the pool that the probability falls in (0 to 1); between pools, the lower one's.

    Scores below all pools get the first rate. Pools and scores meet by slots of the range 0 to 1: a score has one
    slot, and a pool those that it covers, so the join has equal keys. A null probability stays null.
    """
    slot = lambda x: F.greatest(F.lit(0), F.least(F.floor(x * SLOTS), F.lit(SLOTS - 1))).cast("int")
    placed = write_once(ranked(pools, [], ["low"], "_place"), "ranked-pools")
    after = placed.select((F.col("_place") - 1).alias("_of"), F.col("low").alias("_next"))
    ranges = placed.join(after, F.col("_place") == F.col("_of"), "left").select(
        F.when(F.col("_place") == 0, float("-inf")).otherwise(F.col("low")).alias("_low"),
        F.coalesce("_next", F.lit(float("inf"))).alias("_high"), F.col("rate").alias(out))
    bounded = lambda c: F.greatest(F.lit(0.0), F.least(F.col(c), F.lit(1.0)))
    covered = F.sequence(slot(bounded("_low")), slot(bounded("_high")))
    ranges = write_once(ranges.withColumn("_slot", F.explode(covered)), "pool-slots")
    rows = df.withColumn("_at", slot(F.col(prob)))
    inside = (F.col("_at") == F.col("_slot")) & (F.col(prob) >= F.col("_low")) & (F.col(prob) < F.col("_high"))
    return rows.join(ranges, inside, "left").drop("_at", "_slot", "_low", "_high")
