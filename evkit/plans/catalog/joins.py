"""Join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evkit.functions import opponent_of
from evkit.operators.conform import add_key
from evkit.operators.entity import entity_profile, entity_vs_average
from evkit.operators.joins import denormalize, duplicate_keys, lookup_mean, unmatched_keys
from evkit.operators.value import summarize_games
from evkit.plans.catalog.registry import Tables, query
from evkit.plans.catalog.values import summary_sql, team_games


@query(
    "C1 C2 C3 B15",
    """
    SELECT side, opponent, count(*) AS lines, round(sum(l_extendedprice), 2) AS price
    FROM (SELECT l_extendedprice, cn.n_name AS side,
                 CASE WHEN cn.n_name = sn.n_name THEN cr.r_name ELSE sn.n_name END AS opponent
          FROM lineitem
          LEFT JOIN orders ON l_orderkey = o_orderkey
          LEFT JOIN customer ON o_custkey = c_custkey
          LEFT JOIN supplier ON l_suppkey = s_suppkey
          LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey
          LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey
          LEFT JOIN region cr ON cn.n_regionkey = cr.r_regionkey)
    GROUP BY side, opponent""",
)
def role_playing_join(t: Tables) -> DataFrame:
    """The nation table joined as the customer's and as the supplier's."""
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    wide = denormalize(
        lines,
        [
            (t("orders").select("o_orderkey", "o_custkey"), {"l_orderkey": "o_orderkey"}, ""),
            (t("customer").select("c_custkey", "c_nationkey"), {"o_custkey": "c_custkey"}, ""),
            (t("supplier").select("s_suppkey", "s_nationkey"), {"l_suppkey": "s_suppkey"}, ""),
            (t("nation"), {"c_nationkey": "n_nationkey"}, "cust_"),
            (t("nation"), {"s_nationkey": "n_nationkey"}, "supp_"),
            (t("region"), {"cust_n_regionkey": "r_regionkey"}, "cust_"),
        ],
    )
    sides = wide.select(
        F.col("cust_n_name").alias("side"),
        opponent_of("cust_n_name", "supp_n_name", "cust_r_name").alias("opponent"),
        "l_extendedprice",
    )
    return sides.groupBy("side", "opponent").agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )


@query(
    "C5 D10 B26 L10",
    """
    WITH judged AS (SELECT source, lang, quality, toxic FROM documents JOIN labels USING (doc_id)),
    means AS (SELECT source, avg(quality) AS q, avg(toxic) AS x FROM judged
              WHERE lang = 'en' GROUP BY source)
    SELECT doc_id,
           round(coalesce(q, (SELECT avg(quality) FROM judged WHERE lang = 'en')), 6) AS quality_mean,
           round(coalesce(x, (SELECT avg(toxic) FROM judged WHERE lang = 'en')), 6) AS toxic_mean
    FROM documents LEFT JOIN means USING (source)""",
)
def lookup_with_default(t: Tables) -> DataFrame:
    """Mean label of the English documents of a source; sources without one get the overall mean."""
    judged = t("documents").select("doc_id", "source", "lang").join(t("labels"), "doc_id")
    cols = {"quality": "quality_mean", "toxic": "toxic_mean"}
    looked = lookup_mean(
        t("documents").select("doc_id", "source"),
        judged.filter("lang = 'en'"),
        {"source": "source"},
        cols,
    )
    return looked.select("doc_id", *[F.round(c, 6).alias(c) for c in cols.values()])


@query(
    "C2 B13",
    """SELECT c_mktsegment, count(*) AS rows, count(n_name) AS matched, count(DISTINCT key) AS keys
       FROM (SELECT c_mktsegment, n_name, c_mktsegment || '_' || c_nationkey::VARCHAR AS key
             FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2)
       GROUP BY c_mktsegment""",
)
def composite_key_join(t: Tables) -> DataFrame:
    """Two-column key (segment, nation) against a dimension that lacks some of the keys."""
    customers = t("customer").select("c_mktsegment", "c_nationkey")
    segments = customers.join(
        t("nation").filter("n_regionkey <> 2"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    dim = segments.select("c_mktsegment", "n_nationkey", "n_name").distinct()
    keys = {"c_mktsegment": "c_mktsegment", "c_nationkey": "n_nationkey"}
    joined = add_key(denormalize(customers, [(dim, keys, "")]), list(keys), "key")
    return joined.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("n_name").alias("matched"),
        F.count_distinct("key").alias("keys"),
    )


@query(
    "C1 Q1",
    """SELECT o_custkey, count(*) AS rows FROM orders
       WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
       GROUP BY o_custkey""",
)
def unmatched_customers(t: Tables) -> DataFrame:
    """Orders whose customer is missing from the customers in credit."""
    in_credit = t("customer").filter("c_acctbal > 0")
    return unmatched_keys(t("orders"), in_credit, {"o_custkey": "c_custkey"})


@query(
    "C5",
    """SELECT conv_id, count(*) AS rows FROM conversations GROUP BY conv_id HAVING count(*) > 1""",
)
def repeated_conversations(t: Tables) -> DataFrame:
    return duplicate_keys(t("conversations"), ["conv_id"])


@query(
    "C7",
    f"""
    SELECT c_custkey, c_mktsegment, c_acctbal, coalesce(attempts, 0) AS attempts,
           outperform, underperform, total, outperform_pct, avg_delta,
           total IS NOT NULL AS has_profile
    FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS attempts FROM orders GROUP BY o_custkey)
           ON c_custkey = o_custkey
    LEFT JOIN ({summary_sql("player", 10)}) ON c_custkey = player""",
)
def customer_profiles(t: Tables) -> DataFrame:
    summary = summarize_games(team_games(t), "player", min_games=10, scale=4, delta_scale=9)
    kept = ["player", "outperform", "underperform", "total", "outperform_pct", "avg_delta"]
    return entity_profile(
        t("customer").select("c_custkey", "c_mktsegment", "c_acctbal"),
        t("orders"),
        summary.select(*kept),
        "c_custkey",
        fact_key="o_custkey",
        over_under_key="player",
    )


@query(
    "D24 D11 D12 B28 B29",
    """
    SELECT s_suppkey, round(s_acctbal, 6) AS s_acctbal, round(discount, 6) AS discount,
           round(s_acctbal_mean, 6) AS s_acctbal_mean, round(discount_mean, 6) AS discount_mean,
           round_even(s_acctbal - s_acctbal_mean, 4) AS s_acctbal_dev,
           round_even(discount - discount_mean, 4) AS discount_dev,
           printf('%+.4f', s_acctbal - s_acctbal_mean) || ' vs league avg' AS s_acctbal_text,
           printf('%+.4f%%', discount - discount_mean) || ' vs league avg' AS discount_text
    FROM (SELECT *, avg(s_acctbal) OVER () AS s_acctbal_mean, avg(discount) OVER () AS discount_mean
          FROM (SELECT s_suppkey, s_acctbal, discount * 100 AS discount FROM supplier
                JOIN (SELECT l_suppkey, avg(l_discount) AS discount FROM lineitem GROUP BY l_suppkey)
                  ON s_suppkey = l_suppkey))""",
)
def supplier_vs_average(t: Tables) -> DataFrame:
    discounts = t("lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("discount"))
    suppliers = t("supplier").join(discounts, F.col("s_suppkey") == F.col("l_suppkey"))
    compared = entity_vs_average(
        suppliers, "s_suppkey", ["s_acctbal", "discount"], ["discount"], 4, text_decimals=4
    )
    numbers = [c for c in compared.columns if c != "s_suppkey" and not c.endswith("_text")]
    return compared.withColumns({c: F.round(c, 6) for c in numbers})
