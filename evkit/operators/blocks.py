"""Ordered blocks: running values over groups that are too large for one task.

A window puts each of its groups into one task. Where a group may be very large, the rows are
range-partitioned on (group, order) into blocks of similar size instead. Running values are then
computed inside each block, and the totals of the blocks before it are added. Equal sort keys are
the only rows a block cannot divide, so the order should end in a tie-break.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from evkit.functions import sort_keys
from evkit.session import write_once

BLOCK = "_block"
ROWS_PER_TASK = 5_000_000
# More large groups than this are not listed one by one.
MAX_LISTED_GROUPS = 1000


class GroupSizes(NamedTuple):
    rows: int
    largest: int


def group_sizes(df: DataFrame, keys: Sequence[str]) -> GroupSizes:
    """Row count and size of the largest group; one counting pass that returns two numbers."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.sum("n"), F.max("n")).first()
    return GroupSizes(row[0] or 0, row[1] or 0)


def large_groups(df: DataFrame, key: str, over: int) -> list[Row] | None:
    """The groups of more than `over` rows as (key, n), or None if they are too many to list."""
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.filter(F.col("n") > over).limit(MAX_LISTED_GROUPS + 1).collect()
    return found if len(found) <= MAX_LISTED_GROUPS else None


def ordered_blocks(df: DataFrame, order: Sequence[str], rows: int, rows_per_block: int) -> DataFrame:
    """`df` with a block number that never falls along `order`.

    The result is read back from files: block numbers depend on sampled bounds, so every reader
    must see the same ones, also when a lost task is run again.
    """
    blocks = max(1, math.ceil(rows / rows_per_block))
    ranged = df.repartitionByRange(blocks, *sort_keys(order))
    return write_once(ranged.withColumn(BLOCK, F.spark_partition_id()), "blocks")
