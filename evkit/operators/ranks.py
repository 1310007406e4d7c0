"""Places and running sums over groups of any size, without a window over a whole group.

Rows are sorted in ranges of (group, order). A window, where one is needed, sees one range, or one row per range and
group; the totals of earlier ranges are added to what a range finds for itself. So one group may hold all rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evkit.functions import sort_keys
from evkit.session import write_once

# The upper bits of monotonically_increasing_id() number the partition, the lower ones its rows.
ROW_BITS = 33


def _same(groups: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(prefix + g)) for g in groups], F.lit(True))


def _sorted_ranges(df: DataFrame, groups: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """`df` in ranges, with `_place`, which rises along (groups, order), and `_range`; read back from files."""
    keys = [*sort_keys(groups), *sort_keys(order)]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = write_once(ranged.withColumn("_place", F.monotonically_increasing_id()), label)
    return placed.withColumn("_range", F.shiftright("_place", ROW_BITS))


def _before(totals: DataFrame, groups: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """`totals` (one row per range and group) with each column's sum over the group's earlier ranges instead."""
    earlier = Window.partitionBy(*groups or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in cols]
    named = [F.col(g).alias(f"_of_{g}") for g in groups]
    kept = [F.col(c) for c in totals.columns if c not in (*groups, *cols, "_range")]
    return write_once(totals.select(*named, F.col("_range").alias("_of_range"), *sums, *kept), "range-totals")


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str = "rank") -> DataFrame:
    """`df` plus `out`: each row's place in its group by `order`, from 0.

    Names in `order` may begin with "-" for descending. Rows equal in all of `order` are placed in any order, so end
    it with a tie-break. Null groups are groups.
    """
    placed = _sorted_ranges(df, groups, order, "places")
    counts = placed.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("_first"))
    before = _before(counts, groups, ["n"])
    joined = placed.join(before, (F.col("_range") == F.col("_of_range")) & _same(groups, "_of_"))
    return joined.select(*df.columns, (F.col("_before_n") + F.col("_place") - F.col("_first")).alias(out))


def running_sums(df: DataFrame, groups: Sequence[str], order: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """`df` plus, for each {column: out}, the column's sum over the rows before this one in its group by `order`."""
    placed = _sorted_ranges(df, groups, order, "ordered")
    totals = placed.groupBy(*groups, "_range").agg(*[F.sum(c).alias(c) for c in sums])
    before = _before(totals, groups, list(sums))
    joined = placed.join(before, (F.col("_range") == F.col("_of_range")) & _same(groups, "_of_"))
    inside = Window.partitionBy("_range", *groups).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    found = {out: F.col(f"_before_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, out in sums.items()}
    return joined.withColumns(found).select(*df.columns, *found)
