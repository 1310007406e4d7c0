"""Correlation and association."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MANY_CATEGORIES = 1000


def pearson(
    df: DataFrame, label: str, cols: Sequence[str], nulls: str = "pairwise"
) -> DataFrame:
    """`feature`, `corr` of the label with each column, in one pass.

    nulls="pairwise" leaves out rows where either value is null; nulls="zero" counts null as 0.
    """
    if nulls not in ("pairwise", "zero"):
        raise ValueError(f"unknown null policy {nulls!r}")

    def value(c: str):
        return F.col(c) if nulls == "pairwise" else F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    one_row = df.agg(*[F.corr(value(label), value(c)).alias(c) for c in cols])
    return one_row.unpivot([], list(cols), "feature", "corr")


def _check_nulls(nulls: str) -> None:
    if nulls not in ("skip", "zero"):
        raise ValueError(f"unknown null policy {nulls!r}")


def category_sizes(df: DataFrame, nominal: Sequence[str], above: int = MANY_CATEGORIES) -> DataFrame:
    """`column`, `categories` (estimated) of the columns with more than `above` values, in one scan.

    Columns like ids make a cell of almost every row: associations with them take as many cells as there are rows,
    and say little.
    """
    one_row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in nominal])
    return one_row.unpivot([], list(nominal), "column", "categories").filter(F.col("categories") > above)


def pair_cells(df: DataFrame, nominal: Sequence[str]) -> DataFrame:
    """`a`, `b`, `va`, `vb`, `n`: how often the values of each pair of columns meet. Null is a value.

    One scan: a row gives one cell per pair, and cells are counted on the map side.
    """
    pairs = [
        F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"),
            F.col(a).cast("string").alias("va"), F.col(b).cast("string").alias("vb"),
        )
        for a, b in combinations(nominal, 2)
    ]
    cells = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    return cells.groupBy("a", "b", "va", "vb").agg(F.count(F.lit(1)).alias("n"))


def cramers_v(df: DataFrame, nominal: Sequence[str], bias_correction: bool = True) -> DataFrame:
    """Cramér's V of every pair of nominal columns: `a`, `b`, `kind`, `value`.

    Margins are windows over the cells of a pair that share a value. The value is null where a column has one value
    only.
    """
    cells = pair_cells(df, nominal)
    for value, margin, first in (("va", "r", "first_r"), ("vb", "c", "first_c")):
        other = "vb" if value == "va" else "va"
        same = Window.partitionBy("a", "b", value)
        cells = cells.withColumns({
            margin: F.sum("n").over(same), first: F.row_number().over(same.orderBy(other)) == 1,
        })
    share = F.col("n").cast("double") / F.col("r") * (F.col("n").cast("double") / F.col("c"))
    fit = cells.groupBy("a", "b").agg(
        F.sum(share).alias("share"), F.sum("n").cast("double").alias("n"),
        F.count_if("first_r").cast("double").alias("r"), F.count_if("first_c").cast("double").alias("k"),
    )
    phi2 = F.greatest(F.col("share") - 1.0, F.lit(0.0))
    r, k, n = F.col("r"), F.col("k"), F.col("n")
    if bias_correction:
        phi2 = F.greatest(F.lit(0.0), phi2 - (k - 1) * (r - 1) / F.nullif(n - 1, F.lit(0.0)))
        side = F.least(
            k - (k - 1) * (k - 1) / F.nullif(n - 1, F.lit(0.0)) - 1,
            r - (r - 1) * (r - 1) / F.nullif(n - 1, F.lit(0.0)) - 1,
        )
    else:
        side = F.least(k, r) - 1
    return fit.select(
        "a",
        "b",
        F.lit("cramers_v").alias("kind"),
        F.sqrt(F.try_divide(phi2, F.when(side > 0, side))).alias("value"),
    )


def correlation_ratio(
    df: DataFrame, nominal: Sequence[str], numeric: Sequence[str], nulls: str = "skip"
) -> DataFrame:
    """Correlation ratio of every (nominal, numeric) pair: `a`, `b`, `kind`, `value`.

    One scan: counts, means and variances per category of each column, which Spark merges without loss of digits.
    Null numbers are left out (nulls="skip") or count as 0 ("zero"); a null category is a category.
    """
    _check_nulls(nulls)
    numbers = {b: F.col(b).cast("double") for b in numeric}
    if nulls == "zero":
        numbers = {b: F.coalesce(x, F.lit(0.0)) for b, x in numbers.items()}
    columns = F.array(*[F.struct(F.lit(a).alias("a"), F.col(a).cast("string").alias("va")) for a in nominal])
    rows = df.select(F.explode(columns).alias("p"), *[x.alias(f"x{i}") for i, x in enumerate(numbers.values())])
    per_value = rows.groupBy("p.a", "p.va").agg(*[
        F.struct(F.lit(b).alias("b"), F.count(f"x{i}").cast("double").alias("n"), F.avg(f"x{i}").alias("m"),
                 F.var_pop(f"x{i}").alias("v")).alias(f"s{i}")
        for i, b in enumerate(numeric)
    ])
    groups = per_value.select("a", F.explode(F.array(*[f"s{i}" for i in range(len(numeric))])).alias("s"))
    groups = groups.select("a", "s.*").filter("n > 0")
    # The mean of all is the weighted mean of the groups' means.
    pair = Window.partitionBy("a", "b")
    mean = F.sum(F.col("n") * F.col("m")).over(pair) / F.sum("n").over(pair)
    off = F.col("m") - F.col("mean")
    sums = groups.withColumn("mean", mean).groupBy("a", "b").agg(
        F.sum(F.col("n") * off * off).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("between")
    return sums.select(
        "a",
        "b",
        F.lit("correlation_ratio").alias("kind"),
        F.sqrt(F.when(between == 0, F.lit(0.0)).otherwise(F.try_divide(between, between + F.col("within")))).alias("value"),
    )


def numeric_pairs(df: DataFrame, numeric: Sequence[str], nulls: str = "skip") -> DataFrame:
    """Pearson correlation of every pair of numeric columns: `a`, `b`, `kind`, `value`.

    Rows with a null in a pair are left out of it (nulls="skip"), or nulls count as 0 ("zero").
    """
    _check_nulls(nulls)
    value = (lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))) if nulls == "zero" else F.col
    pairs = list(combinations(numeric, 2))
    one_row = df.agg(*[F.corr(value(a), value(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            F.lit("pearson").alias("kind"),
            F.col(f"p{i}").alias("value"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return one_row.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def association_matrix(
    df: DataFrame,
    nominal: Sequence[str],
    numeric: Sequence[str],
    bias_correction: bool = True,
    nulls: str = "skip",
    max_categories: int | None = None,
) -> DataFrame:
    """All pairs of columns, each once, by the measure that fits their kinds.

    `nulls` is "skip" or "zero", as for the parts. With `max_categories`, a nominal column of more values raises
    before any cell is counted (see `category_sizes`).
    """
    if max_categories is not None and nominal:
        many = [r["column"] for r in category_sizes(df, nominal, max_categories).collect()]
        if many:
            raise ValueError(f"more than {max_categories} categories: {', '.join(sorted(many))}")
    parts = []
    if len(nominal) > 1:
        parts.append(cramers_v(df, nominal, bias_correction))
    if nominal and numeric:
        parts.append(correlation_ratio(df, nominal, numeric, nulls))
    if len(numeric) > 1:
        parts.append(numeric_pairs(df, numeric, nulls))
    if not parts:
        raise ValueError("two columns or more are needed")
    matrix = parts[0]
    for part in parts[1:]:
        matrix = matrix.unionByName(part)
    return matrix


def strong_associations(
    matrix: DataFrame, target: str, above: float = 0.07, scale: int | None = 2
) -> DataFrame:
    """`feature`, `value` of the pairs with `target` whose rounded value exceeds `above`."""
    value = F.col("value") if scale is None else F.bround("value", scale)
    return (
        matrix.filter((F.col("a") == target) | (F.col("b") == target))
        .select(
            F.when(F.col("a") == target, F.col("b")).otherwise(F.col("a")).alias("feature"),
            value.alias("value"),
        )
        .filter(F.col("value") > above)
    )
