"""Category dictionaries as tables (L1, L8): counted, ranked and joined by Spark, whatever the number of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evkit.operators.ranks import ranked
from evkit.session import write_once

ORDERS = {
    "frequencyDesc": ["-n", "value"],
    "frequencyAsc": ["n", "value"],
    "alphabetAsc": ["value"],
    "alphabetDesc": ["-value"],
}
UNSEEN = -1.0


def category_table(df: DataFrame, cols: Sequence[str], order: str = "frequencyDesc") -> DataFrame:
    """`column`, `value`, `n`, `index` of every category but null, in one scan (L1).

    Values are counted on the map side, then ranked in ranges: neither a window nor the driver sees a whole column.
    Of equally frequent values the alphabetically first comes first.
    """
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}: one of {', '.join(ORDERS)}")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = df.select(F.explode(cells).alias("cell")).select("cell.*").filter(F.col("value").isNotNull())
    counts = counts.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return ranked(counts, ["column"], ORDERS[order], "index").withColumn("index", F.col("index").cast("double"))


def encode_categories(df: DataFrame, table: DataFrame, cols: dict[str, str], unseen: float = UNSEEN) -> DataFrame:
    """`df` plus a code per {column: out} from a `category_table`; `unseen` for other values and nulls.

    Written tables have a known size: a small dictionary is broadcast, a large one joined by value.
    """
    for col, out in cols.items():
        side = table.filter(F.col("column") == col).select(F.col("value").alias("_value"), F.col("index").alias("_index"))
        df = df.join(side, F.col(col).cast("string") == F.col("_value"), "left")
        df = df.withColumn(out, F.coalesce("_index", F.lit(unseen))).drop("_value", "_index")
    return df


def dictionary(df: DataFrame, cols: Sequence[str], order: str = "alphabetAsc") -> DataFrame:
    """A `category_table` read back from files, for encoding several tables."""
    return write_once(category_table(df, cols, order), "categories")
