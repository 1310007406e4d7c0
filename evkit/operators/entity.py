"""Profiles of all entities at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evkit.functions import signed_text
from evkit.operators.conform import scale_columns
from evkit.operators.profile import deviation


def entity_profile(
    entities: DataFrame,
    facts: DataFrame,
    over_under: DataFrame,
    key: str,
    fact_key: str | None = None,
    over_under_key: str | None = None,
) -> DataFrame:
    """Entity columns, `attempts`, the over/under columns and `has_profile`.

    Entities without enough games have null over/under columns and `has_profile` false.
    """
    fact_key, over_under_key = fact_key or key, over_under_key or key
    attempts = facts.groupBy(F.col(fact_key).alias("_fact")).agg(
        F.count(F.lit(1)).alias("attempts")
    )
    profile = over_under.withColumnRenamed(over_under_key, "_profile")
    return (
        entities.join(attempts, F.col(key) == F.col("_fact"), "left")
        .join(profile, F.col(key) == F.col("_profile"), "left")
        .withColumns(
            {
                "attempts": F.coalesce("attempts", F.lit(0)),
                "has_profile": F.col("_profile").isNotNull(),
            }
        )
        .drop("_fact", "_profile")
    )


def entity_vs_average(
    df: DataFrame,
    key: str,
    metrics: Sequence[str],
    pct_metrics: Sequence[str] = (),
    scale: int | None = None,
    text_decimals: int = 1,
) -> DataFrame:
    """Each entity's metrics next to the mean of all.

    Metrics in `pct_metrics` are fractions and come out as percentages. `<m>_text` reads like
    "+1.2% vs league avg".
    """
    scaled = scale_columns(df.select(key, *metrics), pct_metrics)
    compared = deviation(scaled, metrics, scale)
    return compared.withColumns(
        {
            f"{m}_text": F.concat(
                signed_text(f"{m}_dev", text_decimals, "%" if m in pct_metrics else ""),
                F.lit(" vs league avg"),
            )
            for m in metrics
        }
    )
