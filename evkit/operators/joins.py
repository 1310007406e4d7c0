"""Dimension joins.

No join carries a broadcast hint: Spark broadcasts a side whose size it knows to be below
`spark.sql.autoBroadcastJoinThreshold`, and otherwise shuffles both sides and splits hot keys
(`spark.sql.adaptive.skewJoin`), so a dimension that grows does not break the job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Dim = tuple[DataFrame, Mapping[str, str], str]


def denormalize(fact: DataFrame, dims: Sequence[Dim], how: str = "left") -> DataFrame:
    """Join dimensions onto a fact.

    Each dimension is (table, {fact column: dimension column}, prefix). Its other columns come out
    as prefix + name, so one table can be joined in several roles and no column is doubled.
    """
    for dim, on, prefix in dims:
        keys = list(on.values())
        payload = [c for c in dim.columns if c not in keys]
        side = dim.select(
            *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
            *[F.col(c).alias(prefix + c) for c in payload],
        )
        condition = [F.col(f) == F.col(f"_key{i}") for i, f in enumerate(on)]
        fact = fact.join(side, condition, how).drop(*[f"_key{i}" for i in range(len(keys))])
    return fact


def unmatched_keys(fact: DataFrame, dim: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Fact key values without a dimension row, with their row counts.

    The fact is counted per key before the join, so a hot unmatched key is one row in it.
    """
    counts = fact.groupBy(*on).agg(F.count(F.lit(1)).alias("rows"))
    known = dim.select(*[F.col(d).alias(f"_key{i}") for i, d in enumerate(on.values())])
    condition = [F.col(f) == F.col(f"_key{i}") for i, f in enumerate(on)]
    return counts.join(known, condition, "left_anti")


def duplicate_keys(dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Dimension keys that would multiply fact rows in a join."""
    return dim.groupBy(*on).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def require_unique(dim: DataFrame, on: Sequence[str], name: str = "dimension") -> DataFrame:
    """`dim`, after a count of its keys that raises if one is there twice: it would multiply fact rows."""
    found = duplicate_keys(dim, on).limit(5).collect()
    if found:
        shown = "; ".join(", ".join(str(r[c]) for c in on) for r in found)
        raise ValueError(f"{name} has several rows for: {shown}")
    return dim


def lookup_mean(
    df: DataFrame,
    dim: DataFrame,
    key: Mapping[str, str],
    cols: Mapping[str, str],
    default: str | None = "global_mean",
) -> DataFrame:
    """Look up per-key means of `cols`.

    `key` is {fact column: dimension column}, `cols` {dimension column: output column}. The
    dimension may repeat a key: it is averaged to one row per key first. Keys without a row get
    the mean over all rows of the dimension, or null with `default=None`.
    """
    per_key = dim.groupBy(*[F.col(d).alias(f"_key{i}") for i, d in enumerate(key.values())]).agg(
        *[F.avg(c).alias(out) for c, out in cols.items()]
    )
    condition = [F.col(f) == F.col(f"_key{i}") for i, f in enumerate(key)]
    joined = df.join(per_key, condition, "left").drop(*[f"_key{i}" for i in range(len(key))])
    if default is None:
        return joined
    if default != "global_mean":
        raise ValueError(f"unknown default {default!r}")
    overall = dim.agg(F.struct(*[F.avg(c).alias(out) for c, out in cols.items()])).scalar()
    return joined.withColumns({out: F.coalesce(F.col(out), overall[out]) for out in cols.values()})
