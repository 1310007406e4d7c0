"""Scans and row-level queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evkit.functions import (
    over_flag,
    pct_text,
    point_value_from_type,
    point_value_from_zone,
    signed_text,
    text_to_label,
)
from evkit.operators import conform
from evkit.operators.profile import frequency_table
from evkit.plans.catalog.registry import Tables, query
from evkit.session import scratch_path
from evkit.sources import present, read_table, row_counts


@query(
    "A1 A2 B3",
    """SELECT s_suppkey AS supplier, s_name AS name, s_acctbal AS balance FROM supplier""",
)
def csv_scan(t: Tables) -> DataFrame:
    """The supplier table through CSV files: declared types, columns by name, renamed."""
    path = scratch_path(t.spark, "csv")
    t("supplier").write.csv(path, header=True)
    schema = T.StructType(
        [
            T.StructField("s_acctbal", T.DoubleType()),
            T.StructField("s_suppkey", T.LongType()),
            T.StructField("s_name", T.StringType()),
        ]
    )
    names = {"s_suppkey": "supplier", "s_name": "name", "s_acctbal": "balance"}
    return read_table(t.spark, path, schema, "csv", names)


@query(
    "A4",
    """SELECT count(*) AS rows, count(*) FILTER (event_type = 'purchase') AS purchases,
              count(*) FILTER (value > 50) AS large FROM events""",
)
def event_counts(t: Tables) -> DataFrame:
    return row_counts(
        t("events"), purchases=F.col("event_type") == "purchase", large=F.col("value") > 50
    )


@query(
    "B2 B10 C1",
    """SELECT s_suppkey, upper(n_name) AS nation,
              CASE WHEN n_regionkey = 1 THEN r_name ELSE upper(n_name) END AS area
       FROM supplier JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey""",
)
def conform_names(t: Tables) -> DataFrame:
    """Nations of one region take the name of the region, through a mapping table."""
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    mapping = nations.filter("n_regionkey = 1").select(
        F.upper("n_name").alias("source"), F.col("r_name").alias("target")
    )
    suppliers = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    named = suppliers.select("s_suppkey", F.upper("n_name").alias("nation"))
    return conform.conform_keys(named, "nation", mapping, "area")


@query(
    "B11",
    """SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'B1' WHEN 'Brand#2' THEN 'B2'
                              ELSE p_brand END AS brand FROM part""",
)
def recode_brands(t: Tables) -> DataFrame:
    return t("part").select(
        "p_partkey", conform.recode("p_brand", {"Brand#1": "B1", "Brand#2": "B2"}).alias("brand")
    )


@query(
    "B12 B13",
    """
    WITH names AS (
        SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_name
                               ELSE p_name || ' ' || p_type END AS name FROM part),
    words AS (SELECT p_partkey, name, string_split(name, ' ') AS w FROM names)
    SELECT p_partkey, name,
           CASE WHEN len(w) = 3 THEN w[1] || ' ' || w[2] ELSE w[1] END AS head,
           CASE WHEN len(w) = 3 THEN w[3] ELSE w[2] END AS tail,
           name || '_' || p_partkey::VARCHAR AS key
    FROM words""",
)
def split_names(t: Tables) -> DataFrame:
    """Names of one, two and three words."""
    size = F.col("p_size") % 3
    names = t("part").select(
        "p_partkey",
        F.when(size == 0, F.col("p_brand"))
        .when(size == 1, F.col("p_name"))
        .otherwise(F.concat_ws(" ", "p_name", "p_type"))
        .alias("name"),
    )
    return conform.add_key(
        conform.split_name(names, "name", "head", "tail"), ["name", "p_partkey"], "key"
    )


@query(
    "B16 B17 B18 B19 B23",
    """SELECT event_id,
              CASE WHEN contains(lower(event_type), 'purchase') THEN 1 ELSE 0 END AS bought,
              CASE WHEN contains(props, '3') THEN 3 ELSE 2 END AS zone_value,
              CASE WHEN event_type = 'view' THEN 2 ELSE 3 END AS type_value,
              CASE WHEN value > 10 THEN 'yes' ELSE 'no' END AS "over" FROM events""",
)
def event_labels(t: Tables) -> DataFrame:
    return t("events").select(
        "event_id",
        text_to_label("event_type", "Purchase").alias("bought"),
        point_value_from_zone("props").alias("zone_value"),
        point_value_from_type("event_type", "view").alias("type_value"),
        over_flag("value", F.lit(10.0)).alias("over"),
    )


@query(
    "B27 B28 D1",
    """SELECT value, (pct::VARCHAR) || '%' AS pct_text,
              printf('%+.1f%%', pct - 20) AS signed_text
       FROM (SELECT event_type AS value,
                    round(count(*) / sum(count(*)) OVER () * 100, 1)::DOUBLE AS pct
             FROM events GROUP BY event_type)""",
)
def percent_texts(t: Tables) -> DataFrame:
    table = frequency_table(t("events"), "event_type", scale=1)
    return table.select(
        "value",
        pct_text("pct").alias("pct_text"),
        signed_text(F.col("pct") - 20, 1, "%").alias("signed_text"),
    )


@query(
    "B29",
    """SELECT l_suppkey, round(avg(l_discount * 100), 9) AS l_discount,
              round(avg(l_tax * 100), 9) AS l_tax FROM lineitem GROUP BY l_suppkey""",
)
def rescaled_means(t: Tables) -> DataFrame:
    scaled = conform.scale_columns(t("lineitem"), ["l_discount", "l_tax"])
    return scaled.groupBy("l_suppkey").agg(
        F.round(F.avg("l_discount"), 9).alias("l_discount"), F.round(F.avg("l_tax"), 9).alias("l_tax")
    )


@query(
    "B4 B5 B6 B7 B14",
    """SELECT doc_id, n_chars, quality, toxic,
              CASE WHEN n_chars >= 500 THEN 'Yes' ELSE 'No' END AS qualified,
              round(n_chars / nullif(quality, 0)::DOUBLE, 6) AS per_quality
       FROM documents JOIN labels USING (doc_id) WHERE n_chars >= 100""",
)
def null_policy(t: Tables) -> DataFrame:
    """A left join leaves nulls; rows without labels are dropped, a zero divisor gives null."""
    docs = t("documents").drop("text", "lang", "source").join(t("labels"), "doc_id", "left")
    complete = conform.drop_incomplete(docs, ["quality", "toxic"]).filter("n_chars >= 100")
    flagged = conform.qualify(complete, "n_chars", 500)
    rated = conform.add_ratio(flagged, "n_chars", "quality", "per_quality")
    return rated.withColumn("per_quality", F.round("per_quality", 6))


@query(
    "B26",
    """SELECT doc_id, coalesce(quality, round(avg(quality) OVER (), 6)) AS quality,
              coalesce(toxic, -1) AS toxic
       FROM (SELECT doc_id, quality::DOUBLE AS quality, toxic
             FROM documents LEFT JOIN labels USING (doc_id))""",
)
def filled_labels(t: Tables) -> DataFrame:
    docs = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    docs = docs.withColumn("quality", F.col("quality").cast("double"))
    filled = conform.fill_missing(docs, {"toxic": -1}, ["quality"])
    return filled.withColumn("quality", F.round("quality", 6))


@query("B30 B1", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def wanted_columns(t: Tables) -> DataFrame:
    """Of the wanted columns, those that the table has."""
    customers = t("customer")
    return customers.select(
        *present(customers, ["c_custkey", "c_phone", "c_name", "c_acctbal", "c_comment"])
    )
