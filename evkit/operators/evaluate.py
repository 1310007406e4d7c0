"""Hold-out metrics as single-pass aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evkit.functions import safe_ratio
from evkit.operators.blocks import BLOCK, ROWS_PER_TASK, ordered_blocks
from evkit.operators.ranks import running_sums
from evkit.session import write_once


def confusion_counts(scored: DataFrame, label: str, pred: str) -> DataFrame:
    """One row with tp, fp, tn, fn; class 1 is positive."""
    truth, guess = F.col(label) == 1, F.col(pred) == 1
    return scored.agg(
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(~truth & ~guess).alias("tn"),
        F.count_if(truth & ~guess).alias("fn"),
    )


def confusion_matrix(scored: DataFrame, label: str, pred: str) -> DataFrame:
    """One row per label with `pred_0` and `pred_1`."""
    pivoted = scored.groupBy(F.col(label).cast("int").alias("label"))
    pivoted = pivoted.pivot(pred, [0, 1]).agg(F.count(F.lit(1)))
    return pivoted.select(
        "label",
        F.coalesce(F.col("`0`"), F.lit(0)).alias("pred_0"),
        F.coalesce(F.col("`1`"), F.lit(0)).alias("pred_1"),
    )


def rank_auc(
    scored: DataFrame, label: str, prob: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """One row: `auc`, the exact area under the ROC curve, ties counted half.

    Rows are counted per distinct score first. Up to `rows_per_task` distinct scores are then
    summed along the score in one task; more of them go through `ordered_blocks`. `auc` is null
    when a class is absent.
    """
    scores = (
        scored.filter(F.col(prob).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(prob).alias("score"))
        .agg(
            F.count_if(F.col(label) == 1).cast("double").alias("p"),
            F.count_if(F.col(label) != 1).cast("double").alias("n"),
        )
    )
    distinct = scored.agg(F.approx_count_distinct(prob)).first()[0]
    upto = (Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(Window.orderBy("score").rowsBetween(*upto)), F.lit(0.0))
    if distinct <= rows_per_task:
        summed = scores.withColumn("below", below)
    else:
        blocks = ordered_blocks(scores, ["score"], distinct, rows_per_task)
        totals = blocks.groupBy(BLOCK).agg(F.sum("n").alias("n"))
        # One row per block.
        earlier = Window.orderBy(BLOCK).rowsBetween(*upto)
        offsets = totals.select(
            F.col(BLOCK).alias("_b"), F.coalesce(F.sum("n").over(earlier), F.lit(0.0)).alias("off")
        )
        inside = Window.partitionBy(BLOCK).orderBy("score").rowsBetween(*upto)
        summed = (
            blocks.withColumn("in_block", F.coalesce(F.sum("n").over(inside), F.lit(0.0)))
            .join(offsets, F.col(BLOCK) == F.col("_b"))
            .withColumn("below", F.col("off") + F.col("in_block"))
        )
    wins = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2))
    return summed.agg(F.try_divide(wins, F.sum("p") * F.sum("n")).alias("auc"))


def evaluate(
    scored: DataFrame, label: str, prob: str, pred: str, by: Sequence[str] = (), rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """accuracy, precision, recall, auc, tp, fp, tn, fn; one row, or one per value of `by`.

    The rows are read once and counted per distinct score; every metric comes from those counts. Precision and recall
    are null where nothing was predicted, or nothing is positive, `auc` where a class is absent. Beyond
    `rows_per_task` distinct scores, the sums along the score are made in ranges.
    """
    truth, guess = F.col(label) == 1, F.col(pred) == 1
    cells = scored.groupBy(*by, F.col(prob).alias("_score")).agg(
        F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"),
        F.count_if(~truth & ~guess).alias("tn"), F.count_if(truth & ~guess).alias("fn"),
        F.count_if(truth).alias("_p"), F.count_if(~truth).alias("_n"),
    )
    cells = write_once(cells, "score-cells")
    ranked = cells.filter(F.col("_score").isNotNull())
    if cells.count() <= rows_per_task:
        earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
        ranked = ranked.withColumn("_below", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    else:
        ranked = running_sums(ranked, list(by), ["_score"], {"_n": "_below"})
    # Rows without a score count in all but the area.
    rest = cells.filter(F.col("_score").isNull()).withColumns({c: F.lit(0).cast("long") for c in ("_p", "_n", "_below")})
    p, n = F.col("_p").cast("double"), F.col("_n").cast("double")
    wins = F.sum(p * (F.col("_below") + n / 2))
    sums = ranked.unionByName(rest).groupBy(*by).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "tn", "fn")],
        F.try_divide(wins, F.sum(p) * F.sum(n)).alias("auc"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return sums.select(
        *by,
        safe_ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall"),
        "auc",
        "tp",
        "fp",
        "tn",
        "fn",
    )
