"""Expressions that several operators share."""

from __future__ import annotations

import ctypes
import ctypes.util

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# White space that separates words.
SPACES = r"[\x20\x09-\x0D]+"


def open_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are; null stays null."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space, tab, line feed, VT, FF and CR; null counts 0."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    # Only the first and the last part can be empty.
    edges = (parts[0] == "").cast("long") + (
        (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
    ).cast("long")
    return F.size(parts).cast("long") - edges


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns as one struct: operators then add columns of any name beside it."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def row_fields(df: DataFrame, columns: list[str], row: str = "row") -> list[Column]:
    """The fields of `whole_row` as columns again, without those that `columns` of `df` replace."""
    new = {c.lower() for c in columns}
    fields = [c for c in df.schema[row].dataType.names if c.lower() not in new]
    return [F.col(row).getField(c).alias(c) for c in fields]


def with_new(df: DataFrame, columns: list[str], row: str = "row") -> DataFrame:
    """The fields of the row struct, then `columns`; fields with the name of a new column are replaced."""
    return df.select(*row_fields(df, columns, row), *columns)


def give_back() -> None:
    """Free memory of a Python worker goes back to the system: Spark keeps workers for later tasks beside new ones."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c") or None), "malloc_trim", None)
    if trim is not None:
        trim(0)
