"""Profiling: frequencies, rankings, deviations, facets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evkit.functions import as_col, flag_to_label, rounded


def _nulls_last(by: str, desc: bool) -> Column:
    return F.col(by).desc_nulls_last() if desc else F.col(by).asc_nulls_last()


def frequency_table(
    df: DataFrame,
    col: str,
    top: int | None = None,
    scale: int | None = 2,
    drop_null: bool = False,
    rounding: str = "half_up",
) -> DataFrame:
    """`value`, `count` and `pct` of all rows, for every value or the `top` most frequent.

    The percentages relate to all groups, before the cut. The total is a scalar subquery over the
    same counts, whose shuffle Spark runs once for both.
    """
    if drop_null:
        df = df.filter(F.col(col).isNotNull())
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").cast("double").alias("total")).scalar()
    table = counts.withColumn(
        "pct", rounded(F.col("count").cast("double") / total * F.lit(100.0), scale, rounding)
    )
    return table if top is None else top_k(table, "count", top, tiebreak=["value"])


def top_k(
    df: DataFrame, by: str, k: int, desc: bool = True, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """The k largest or smallest rows, nulls last either way."""
    return df.orderBy(_nulls_last(by, desc), *[F.col(c).asc() for c in tiebreak]).limit(k)


def both_tails(df: DataFrame, metric: str, k: int, key: str) -> DataFrame:
    """The k//2 lowest and k//2 highest rows, one row per key, highest first."""
    half = k // 2
    low = top_k(df, metric, half, desc=False, tiebreak=[key]).withColumn("_side", F.lit(0))
    high = top_k(df, metric, half, desc=True, tiebreak=[key]).withColumn("_side", F.lit(1))
    # At most k rows come in.
    first = Window.partitionBy(key).orderBy("_side", metric)
    return (
        low.unionByName(high)
        .withColumn("_nth", F.row_number().over(first))
        .filter("_nth = 1")
        .drop("_side", "_nth")
        .orderBy(F.col(metric).desc_nulls_last(), F.col(key))
    )


def rankings(
    df: DataFrame, key: str, metrics: Sequence[str], k: int, desc: bool = True
) -> DataFrame:
    """The top (or bottom) k keys for each of several metrics: `metric`, `rank`, key, `score`.

    One pass over `df` for all metrics. Spark keeps k rows per metric and task before the shuffle;
    above its limit for that, each metric gets a `top_k` of its own.
    """
    scores = df.select(key, *[F.col(m).cast("double").alias(m) for m in metrics])
    long = scores.unpivot([key], list(metrics), "metric", "score")
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if k > limit:
        parts = [
            top_k(long.filter(F.col("metric") == m), "score", k, desc, [key]) for m in metrics
        ]
        long = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("metric").orderBy(_nulls_last("score", desc), F.col(key))
    ranked = long.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def global_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the mean of each column."""
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def deviation(
    df: DataFrame, cols: Sequence[str], scale: int | None = None, rounding: str = "half_even"
) -> DataFrame:
    """Add `<c>_mean`, the mean over all rows, and `<c>_dev`, the distance from it."""
    mean = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()
    with_mean = df.withColumns({f"{c}_mean": mean[c] for c in cols})
    return with_mean.withColumns(
        {f"{c}_dev": rounded(F.col(c) - F.col(f"{c}_mean"), scale, rounding) for c in cols}
    )


def value_range(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with `<c>_min` and `<c>_max`."""
    return df.agg(
        *[f(c).alias(f"{c}_{name}") for c in cols for name, f in (("min", F.min), ("max", F.max))]
    )


def minmax(df: DataFrame, col: str, eps: float = 1e-9) -> DataFrame:
    """Add `<col>_norm` = (x - min) / (max - min + eps)."""
    ends = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    spread = ends["hi"] - ends["lo"] + F.lit(eps)
    return df.withColumn(f"{col}_norm", (F.col(col) - ends["lo"]) / spread)


def mode_value(df: DataFrame, col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Most frequent value, the smallest among ties.

    Values are counted first, so no task holds the values of a group.
    """
    counts = (
        df.filter(F.col(col).isNotNull())
        .groupBy(*group_cols, F.col(col).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return counts.groupBy(*group_cols).agg(
        F.min(F.struct(-F.col("_n"), F.col("_value")))["_value"].alias("top_value")
    )


def kpis(
    df: DataFrame,
    made: str | Column,
    top: str,
    group_cols: Sequence[str] = (),
    scale: int | None = None,
) -> DataFrame:
    """`total`, `made`, `missed`, `rate` (percent, 0 when empty) and `top_value`.

    One row, or one per group. Rows are counted per (group, `top`) first; the rest works on those
    counts.
    """
    cells = (
        df.select(*group_cols, F.col(top).alias("_value"), flag_to_label(as_col(made)).alias("_hit"))
        .groupBy(*group_cols, "_value")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_hit").alias("_made"))
    )
    most = F.when(F.col("_value").isNotNull(), F.struct(-F.col("_n"), F.col("_value")))
    bundle = cells.groupBy(*group_cols).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("_made"), F.lit(0)).alias("made"),
        F.min(most)["_value"].alias("top_value"),
    )
    rate = F.try_divide(F.col("made").cast("double"), F.col("total").cast("double")) * F.lit(100.0)
    return bundle.select(
        *group_cols,
        "total",
        "made",
        (F.col("total") - F.col("made")).alias("missed"),
        rounded(F.coalesce(rate, F.lit(0.0)), scale, "half_even").alias("rate"),
        "top_value",
    )


def argmax_row(
    df: DataFrame, metric: str, key: str, group_cols: Sequence[str] = (), desc: bool = True
) -> DataFrame:
    """The row with the largest (or smallest) metric, the smallest key among ties."""
    payload = [c for c in df.columns if c not in group_cols]
    score = F.col(metric) if not desc else -F.col(metric)
    best = F.min_by(F.struct(*payload), F.struct(score.alias("s"), F.col(key).alias("k")))
    rows = df.filter(F.col(metric).isNotNull()).groupBy(*group_cols).agg(best.alias("_row"))
    return rows.filter(F.col("_row").isNotNull()).select(*group_cols, "_row.*")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values without null."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def dedupe(
    df: DataFrame, keys: Sequence[str] | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """Whole-row duplicates, or the first row by `order` for each key.

    The kept row is chosen by an aggregate, which combines on the map side, so a key with very
    many rows costs no more than others.
    """
    if not keys:
        return df.distinct()
    if not order:
        raise ValueError("dedupe by key needs an order that says which row stays")
    payload = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*payload), F.struct(*order))
    return (
        df.groupBy(*keys).agg(first.alias("_row")).select(*keys, "_row.*").select(*df.columns)
    )


def facet_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Row counts for every prefix of the facets.

    `level` is the number of facets fixed; the rows of a level whose first facets equal the
    choices made so far are the choices that remain. Rows are counted per full combination before
    the rollup.
    """
    cells = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    rolled = cells.rollup(*cols).agg(
        F.sum("_n").alias("count"),
        (F.lit(len(cols)) - F.bit_count(F.grouping_id())).cast("int").alias("level"),
    )
    # A null below `level` is a missing value, not a rolled-up facet: it is never a choice.
    offered = [(F.col("level") <= i) | F.col(c).isNotNull() for i, c in enumerate(cols)]
    return rolled.filter(reduce(lambda a, b: a & b, offered)).select(*cols, "count", "level")
