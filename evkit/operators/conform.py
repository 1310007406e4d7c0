"""Row-level cleaning and key conforming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evkit.functions import as_col, safe_ratio

# Longer lists are joined instead of being written into the plan.
MAX_INLINE_VALUES = 1000


def conform_keys(
    df: DataFrame,
    col: str,
    mapping: DataFrame,
    out: str,
    source: str = "source",
    target: str = "target",
    upper: bool = False,
) -> DataFrame:
    """Replace values of `col` through a (source, target) table; others keep their value."""
    key = F.upper(F.col(col)) if upper else F.col(col)
    lookup = mapping.select(F.col(source).alias("_from"), F.col(target).alias("_to"))
    joined = df.withColumn("_key", key).join(lookup, F.col("_key") == F.col("_from"), "left")
    return joined.withColumn(out, F.coalesce("_to", "_key")).drop("_key", "_from", "_to")


def recode(col: str | Column, codes: Mapping[str, str]) -> Column:
    """Expression form of `conform_keys` for a handful of codes."""
    col = as_col(col)
    result = col
    for old, new in codes.items():
        result = F.when(col == old, new).otherwise(result)
    return result


def split_name(df: DataFrame, col: str, head: str, tail: str, sep: str = " ") -> DataFrame:
    """Split a name in two.

    Three words give (first two, last); any other count gives (first, second), with a null second
    where there is only one word.
    """
    words = F.split(F.col(col), sep)
    three = F.size(words) == 3
    return df.withColumns(
        {
            head: F.when(three, F.concat_ws(sep, F.get(words, 0), F.get(words, 1))).otherwise(
                F.get(words, 0)
            ),
            tail: F.when(three, F.get(words, 2)).otherwise(F.get(words, 1)),
        }
    )


def add_key(df: DataFrame, cols: Sequence[str], out: str, sep: str = "_") -> DataFrame:
    """One string key from several columns, null if any part is null."""
    parts: list[Column] = []
    for c in cols:
        parts += [F.lit(sep), F.col(c).cast("string")]
    return df.withColumn(out, F.concat(*parts[1:]))


def qualify(df: DataFrame, col: str, at_least: float, out: str = "qualified") -> DataFrame:
    """'Yes' / 'No' flag for a threshold; a null value is 'No' (B7)."""
    return df.withColumn(out, F.when(F.col(col) >= at_least, "Yes").otherwise("No"))


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any column, or in any column of `subset`."""
    return df.dropna("any", subset=list(subset) if subset else None)


def add_ratio(df: DataFrame, num: str, den: str, out: str) -> DataFrame:
    """Ratio of two columns, null on a zero divisor."""
    return df.withColumn(out, safe_ratio(num, den))


def slice_rows(df: DataFrame, **selection: Sequence | DataFrame) -> DataFrame:
    """Keep rows whose columns all hold a selected value.

    A selection is a list, or a one-column DataFrame which is then joined as a left semi join; so are long lists.
    """
    for col, wanted in selection.items():
        if not isinstance(wanted, DataFrame) and len(wanted) > MAX_INLINE_VALUES:
            values = [(v,) for v in wanted if v is not None]
            wanted = df.sparkSession.createDataFrame(values, T.StructType([T.StructField("value", df.schema[col].dataType)]))
        if isinstance(wanted, DataFrame):
            name = wanted.columns[0]
            chosen = wanted.select(F.col(name).alias("_wanted"))
            df = df.join(chosen, F.col(col) == F.col("_wanted"), "left_semi")
        else:
            df = df.filter(F.col(col).isin(list(wanted)))
    return df


def scale_columns(df: DataFrame, cols: Sequence[str], factor: float = 100.0) -> DataFrame:
    """Multiply the named columns, e.g. fractions to percentages."""
    return df.withColumns({c: F.col(c) * F.lit(float(factor)) for c in cols})


def fill_missing(df: DataFrame, constants: Mapping[str, object] | None = None,
                 means: Sequence[str] = ()) -> DataFrame:
    """Fill nulls with constants, or with the column mean for the columns in `means`."""
    if means:
        mean = df.agg(F.struct(*[F.avg(c).alias(c) for c in means])).scalar()
        df = df.withColumns({c: F.coalesce(F.col(c), mean[c]) for c in means})
    return df.na.fill(dict(constants)) if constants else df
