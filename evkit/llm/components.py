"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evkit.session import write_once


def components(links: DataFrame) -> DataFrame:
    """(id, label) of each end of `links` (a, b): label is the smallest id reachable.

    Each round takes the smallest label of the neighbours, then that label's own label, and is written,
    so a lost executor costs one round at most. Only the number of changes reaches the driver.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = write_once(both.filter("a <> b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low"))
    labels = write_once(labels.select("id", F.least("id", "low").alias("label")), "labels")
    while True:
        of = labels.select(F.col("id").alias("b"), F.col("label").alias("near"))
        near = both.join(of, "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        step = labels.join(near, "id").select(
            "id", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        step = step.join(jump, "label").select("id", "old", F.least("label", "far").alias("label"))
        step = write_once(step, "labels")
        changed = step.filter("label <> old").limit(1).count()
        labels = step.select("id", "label")
        if not changed:
            return labels
