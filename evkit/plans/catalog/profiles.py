"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evkit.operators.profile import (
    argmax_row,
    both_tails,
    dedupe,
    deviation,
    distinct_values,
    facet_counts,
    frequency_table,
    global_means,
    kpis,
    mode_value,
    top_k,
)
from evkit.plans.catalog.registry import Tables, query


def frequency_sql(table: str, col: str, round_fn: str = "round", tail: str = "") -> str:
    return f"""
    SELECT {col} AS value, count(*) AS count,
           {round_fn}(count(*) / (sum(count(*)) OVER ())::DOUBLE * 100, 4) AS pct
    FROM {table} GROUP BY {col} {tail}"""


@query("D1", frequency_sql("events", "event_type"))
def freq_event_type(t: Tables) -> DataFrame:
    return frequency_table(t("events"), "event_type", scale=4)


@query("D1", frequency_sql("part", "p_type"))
def freq_part_type(t: Tables) -> DataFrame:
    return frequency_table(t("part"), "p_type", scale=4)


@query("D1", frequency_sql("orders", "o_orderpriority"))
def freq_order_priority(t: Tables) -> DataFrame:
    return frequency_table(t("orders"), "o_orderpriority", scale=4)


@query("D1", frequency_sql("lineitem", "l_returnflag"))
def freq_return_flag(t: Tables) -> DataFrame:
    return frequency_table(t("lineitem"), "l_returnflag", scale=4)


@query("D1", frequency_sql("lineitem", "l_linenumber"))
def freq_line_number(t: Tables) -> DataFrame:
    return frequency_table(t("lineitem"), "l_linenumber", scale=4)


@query(
    "D1",
    frequency_sql("(SELECT quality FROM documents LEFT JOIN labels USING (doc_id))", "quality"),
)
def freq_quality_with_nulls(t: Tables) -> DataFrame:
    """Nulls form a group."""
    docs = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return frequency_table(docs, "quality", scale=4)


@query(
    "D2",
    frequency_sql(
        "(SELECT quality FROM documents LEFT JOIN labels USING (doc_id)) WHERE quality IS NOT NULL",
        "quality",
        "round_even",
    ),
)
def freq_quality_without_nulls(t: Tables) -> DataFrame:
    """Nulls count neither as a group nor in the total."""
    docs = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return frequency_table(docs, "quality", scale=4, drop_null=True, rounding="half_even")


@query("D2 F3", frequency_sql("part", "p_brand", "round_even", "ORDER BY count DESC, value LIMIT 10"))
def top_brands(t: Tables) -> DataFrame:
    return frequency_table(t("part"), "p_brand", 10, 4, True, "half_even")


@query(
    "F3",
    """SELECT user_id AS value, count(*) AS count FROM events GROUP BY user_id
       ORDER BY count, value LIMIT 10""",
)
def least_active_users(t: Tables) -> DataFrame:
    table = frequency_table(t("events"), "user_id").select("value", "count")
    return top_k(table, "count", 10, desc=False, tiebreak=["value"])


@query(
    "F2 D17",
    """SELECT s_name, s_acctbal FROM (SELECT DISTINCT s_name, s_acctbal FROM supplier)
       ORDER BY s_acctbal DESC, s_name LIMIT 10""",
)
def top_suppliers(t: Tables) -> DataFrame:
    pairs = dedupe(t("supplier").select("s_name", "s_acctbal"))
    return top_k(pairs, "s_acctbal", 10, tiebreak=["s_name"])


@query("F2", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10")
def bottom_customers(t: Tables) -> DataFrame:
    pairs = t("customer").select("c_custkey", "c_acctbal")
    return top_k(pairs, "c_acctbal", 10, desc=False, tiebreak=["c_custkey"])


@query(
    "F1 F2",
    """SELECT p_partkey, p_brand, p_size, p_retailprice FROM part
       ORDER BY p_size DESC, p_brand, p_retailprice, p_partkey LIMIT 30""",
)
def largest_parts(t: Tables) -> DataFrame:
    parts = t("part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return top_k(parts, "p_size", 30, tiebreak=["p_brand", "p_retailprice", "p_partkey"])


@query(
    "D11 D12 F5 G1",
    """
    WITH volume AS (SELECT l_suppkey, count(*) AS lines FROM lineitem GROUP BY l_suppkey),
    dev AS (SELECT *, round(avg(lines) OVER (), 6) AS lines_mean,
                   round_even(lines - avg(lines) OVER (), 4) AS lines_dev FROM volume),
    ranked AS (SELECT *, row_number() OVER (ORDER BY lines_dev, l_suppkey) AS low,
                      row_number() OVER (ORDER BY lines_dev DESC, l_suppkey) AS high FROM dev)
    SELECT l_suppkey, lines, lines_mean, lines_dev FROM ranked WHERE low <= 10 OR high <= 10""",
)
def supplier_volume_tails(t: Tables) -> DataFrame:
    volume = t("lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"))
    tails = both_tails(deviation(volume, ["lines"], 4), "lines_dev", 20, "l_suppkey")
    return tails.withColumn("lines_mean", F.round("lines_mean", 6))


@query(
    "D10 D11",
    """SELECT round(avg(l_quantity), 4) AS l_quantity, round(avg(l_discount), 6) AS l_discount,
              round(avg(l_tax), 6) AS l_tax FROM lineitem""",
)
def line_means(t: Tables) -> DataFrame:
    cols = {"l_quantity": 4, "l_discount": 6, "l_tax": 6}
    return global_means(t("lineitem"), list(cols)).select(
        *[F.round(c, scale).alias(c) for c, scale in cols.items()]
    )


@query(
    "A4 D14 D15",
    """SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS made,
              count(*) FILTER (event_type <> 'purchase') AS missed,
              round(count(*) FILTER (event_type = 'purchase') / count(*)::DOUBLE * 100, 4) AS rate,
              (SELECT event_type FROM events GROUP BY event_type
               ORDER BY count(*) DESC, event_type LIMIT 1) AS top_value
       FROM events""",
)
def event_kpis(t: Tables) -> DataFrame:
    return kpis(t("events"), F.col("event_type") == "purchase", "event_type", scale=4)


@query(
    "D14 D15",
    """
    WITH cells AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
    tops AS (SELECT user_id, event_type AS top_value FROM cells
             QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1)
    SELECT user_id, total, made, total - made AS missed, round(made / total::DOUBLE * 100, 4) AS rate,
           top_value
    FROM (SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS made
          FROM events GROUP BY user_id) JOIN tops USING (user_id)""",
)
def user_kpis(t: Tables) -> DataFrame:
    return kpis(t("events"), F.col("event_type") == "purchase", "event_type", ["user_id"], 4)


@query(
    "D14",
    """SELECT l_suppkey, l_linenumber AS top_value
       FROM (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
       QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) = 1""",
)
def usual_line_number(t: Tables) -> DataFrame:
    return mode_value(t("lineitem"), "l_linenumber", ["l_suppkey"])


@query(
    "D13",
    """SELECT c_nationkey, c_custkey, c_acctbal FROM customer
       QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1""",
)
def richest_customers(t: Tables) -> DataFrame:
    customers = t("customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return argmax_row(customers, "c_acctbal", "c_custkey", ["c_nationkey"])


@query("D16", "SELECT DISTINCT p_name FROM part")
def part_names(t: Tables) -> DataFrame:
    return distinct_values(t("part"), "p_name")


@query("D17", "SELECT DISTINCT lang, source FROM documents")
def document_kinds(t: Tables) -> DataFrame:
    return dedupe(t("documents").select("lang", "source"))


@query(
    "D17",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""",
)
def first_orders(t: Tables) -> DataFrame:
    orders = t("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return dedupe(orders, ["o_custkey"], ["o_orderkey"])


@query(
    "D22",
    """SELECT l_returnflag, l_linestatus, o_orderpriority, count(*) AS count,
              (3 - bit_count(grouping_id(l_returnflag, l_linestatus, o_orderpriority)))::INTEGER AS level
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       GROUP BY ROLLUP (l_returnflag, l_linestatus, o_orderpriority)""",
)
def facet_rollup(t: Tables) -> DataFrame:
    lines = t("lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    priorities = t("orders").select("o_orderkey", "o_orderpriority")
    joined = lines.join(priorities, F.col("l_orderkey") == F.col("o_orderkey"))
    return facet_counts(joined, ["l_returnflag", "l_linestatus", "o_orderpriority"])


@query(
    "D22",
    """SELECT lang, source, quality, count(*) AS count,
              (3 - bit_count(grouping_id(lang, source, quality)))::INTEGER AS level
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source, quality)
       HAVING grouping(quality) = 1 OR quality IS NOT NULL""",
)
def facet_rollup_with_nulls(t: Tables) -> DataFrame:
    """A missing value is never a choice."""
    docs = t("documents").select("doc_id", "lang", "source").join(t("labels"), "doc_id", "left")
    return facet_counts(docs, ["lang", "source", "quality"])
