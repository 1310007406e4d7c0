"""Table scans, the persisted scored-events table, and sorted files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evkit.functions import as_col, sort_keys


def present(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Those of the wanted columns that `df` has, in the wanted order; case does not matter."""
    have = {c.lower() for c in df.columns}
    return [c for c in wanted if c.lower() in have]


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    fmt: str = "parquet",
    rename: Mapping[str, str] | None = None,
    optional: T.StructType | None = None,
    infer: bool = False,
    keep_others: bool = False,
) -> DataFrame:
    """Scan Parquet or CSV with a declared schema (A1, A2).

    CSV columns are matched by header name, not by position, so files may hold more columns, in
    any order; only the header is read up front. A malformed value stops the job. `optional`
    names columns that are taken only where the file has them; `keep_others=True` also keeps the
    undeclared ones, as text in CSV. `infer=True` lets Spark guess the types instead, at the price
    of one more scan.
    """
    if fmt == "parquet":
        df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    elif fmt == "csv" and infer:
        df = spark.read.csv(path, header=True, inferSchema=True)
    elif fmt == "csv":
        header = spark.read.csv(path, header=True).columns
        kinds = {f.name.lower(): f.dataType for f in [*schema, *(optional or [])]}
        full = T.StructType(
            [T.StructField(name, kinds.get(name.lower(), T.StringType())) for name in header]
        )
        df = spark.read.schema(full).csv(path, header=True, enforceSchema=False, mode="FAILFAST")
    else:
        raise ValueError(f"unknown format {fmt!r}")
    missing = [f.name for f in schema if not present(df, [f.name])]
    if missing:
        raise ValueError(f"columns missing from {path}: {', '.join(missing)}")
    names = [f.name for f in schema] + present(df, [f.name for f in optional or []])
    if keep_others:
        taken = {n.lower() for n in names}
        names += [c for c in df.columns if c.lower() not in taken]
    rename = rename or {}
    return df.select(*[df[f"`{n}`"].alias(rename.get(n, n)) for n in names])


def write_scored(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Persist scored events as Parquet (A3).

    `partition_by` is for columns of few values (season, conference). Rows keep their tasks, so
    one large value is written by many tasks, not one.
    """
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Write `df` into a table below `path`, replacing the partitions that it has rows for and no others (A3).

    So a run for one season can be repeated, also after a failure or with late rows, without touching other
    seasons, and gives the same table each time. `df` must not read the partitions that it replaces.
    """
    if not partition_by:
        raise ValueError("partition columns are needed: without them the whole table would be replaced")
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


def write_sorted(df: DataFrame, path: str, order: Sequence[str], files: int | None = None) -> None:
    """Write all rows in one order, across files too: file by file, rows follow `order` (F1).

    Names may begin with "-" for descending; directions may be mixed. Ranges are cut by sampling, one file each, so no
    task sorts everything. `files` fixes their number.
    """
    keys = sort_keys(order)
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("errorifexists").parquet(path)


def order_breaks(spark: SparkSession, path: str, order: Sequence[str]) -> DataFrame:
    """`file`, `row` of the rows below `path` that sort before the row ahead of them, in its file or the file before.

    Without any, the files hold one sorted sequence. A window sees one file, or one row per file.
    """
    keys = [o.removeprefix("-") for o in order]

    def after(left: str, right: str) -> Column:
        """The row `left` sorts after `right`; nulls come first, or last where the order is descending."""
        found = F.lit(False)
        for o, key in reversed(list(zip(order, keys))):
            a, b = F.col(f"{left}.{key}"), F.col(f"{right}.{key}")
            a, b = (b, a) if o.startswith("-") else (a, b)
            behind = F.coalesce(a > b, a.isNotNull() & b.isNull())
            found = behind | (a.eqNullSafe(b) & found)
        return found

    rows = spark.read.parquet(path)
    rows = rows.select(
        F.struct(*keys).alias("now"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    own = Window.partitionBy("file").orderBy("row")
    inside = rows.withColumn("ahead", F.lag("now").over(own)).filter(F.col("ahead").isNotNull() & after("ahead", "now"))
    edges = rows.groupBy("file").agg(F.min_by("now", "row").alias("now"), F.max_by("now", "row").alias("last"))
    number = F.regexp_extract("file", r"^part-([0-9]+)", 1).cast("long")
    before = F.lag("last").over(Window.orderBy(number, "file"))
    borders = edges.withColumn("ahead", before).filter(F.col("ahead").isNotNull() & after("ahead", "now"))
    return inside.select("file", "row").unionByName(borders.select("file", F.lit(0).cast("long").alias("row")))


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def row_counts(df: DataFrame, **conditions: str | Column) -> DataFrame:
    """One row: `rows`, and one count per named condition, all in a single scan (A4)."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(as_col(c)).alias(name) for name, c in conditions.items()],
    )
