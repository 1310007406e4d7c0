"""Correlation and association queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evkit.operators.assoc import (
    association_matrix,
    correlation_ratio,
    cramers_v,
    numeric_pairs,
    pearson,
    strong_associations,
)
from evkit.plans.catalog.registry import Tables, query


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


def cramers_sql(table: str, pairs, corrected: bool = True, scale: int = 6) -> str:
    """The measure from the textbook table: expected counts from the margins of each cell."""

    def one(a: str, b: str) -> str:
        phi = "greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1))" if corrected else "chi2 / n"
        side = (
            "least(k - (k - 1) * (k - 1) / (n - 1), r - (r - 1) * (r - 1) / (n - 1)) - 1"
            if corrected
            else "least(k, r) - 1"
        )
        return f"""
        SELECT '{a}' AS a, '{b}' AS b, 'cramers_v' AS kind,
               round(sqrt(({phi}) / ({side})), {scale}) AS value
        FROM (SELECT n, r, k, sum(cnt::DOUBLE * cnt * n / (ra::DOUBLE * cb)) - n AS chi2
              FROM (SELECT cnt, sum(cnt) OVER (PARTITION BY x)::DOUBLE AS ra,
                           sum(cnt) OVER (PARTITION BY y)::DOUBLE AS cb
                    FROM (SELECT {a} AS x, {b} AS y, count(*) AS cnt FROM {table} GROUP BY ALL)),
                   (SELECT count(*)::DOUBLE AS n, count(DISTINCT {a})::DOUBLE AS r,
                           count(DISTINCT {b})::DOUBLE AS k FROM {table})
              GROUP BY n, r, k)"""

    return _union([one(a, b) for a, b in pairs])


def ratio_sql(table: str, pairs, scale: int = 6) -> str:
    """Square root of the share of variance between groups."""

    def one(a: str, b: str) -> str:
        return f"""
        SELECT '{a}' AS a, '{b}' AS b, 'correlation_ratio' AS kind,
               round(sqrt(sum(n * (m - g) * (m - g)) / max(total)), {scale}) AS value
        FROM (SELECT {a}, count({b}) AS n, avg({b}) AS m FROM {table} GROUP BY {a}),
             (SELECT avg({b}) AS g, var_pop({b}) * count({b}) AS total FROM {table})"""

    return _union([one(a, b) for a, b in pairs])


def pearson_sql(table: str, pairs, scale: int = 6) -> str:
    return _union(
        [
            f"""SELECT '{a}' AS a, '{b}' AS b, 'pearson' AS kind, round(corr({a}, {b}), {scale})
                AS value FROM {table}"""
            for a, b in pairs
        ]
    )


FLAGS = ["l_returnflag", "l_linestatus", "l_linenumber"]
MEASURES = ["l_quantity", "l_discount", "l_extendedprice"]
LINE_PAIRS = list(combinations(FLAGS, 2))
MIXED_PAIRS = [(a, b) for a in FLAGS for b in MEASURES]
JUDGED = "(SELECT * FROM documents JOIN labels USING (doc_id))"
MATRIX_SQL = _union(
    [
        cramers_sql(JUDGED, [("lang", "source")]),
        ratio_sql(JUDGED, [(a, b) for a in ("lang", "source") for b in ("n_chars", "quality", "toxic")]),
        pearson_sql(JUDGED, [("n_chars", "quality"), ("n_chars", "toxic"), ("quality", "toxic")]),
    ]
)


def judged_columns(t: Tables) -> DataFrame:
    docs = t("documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(t("labels"), "doc_id")


def to_six(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


@query("D20", cramers_sql("lineitem", LINE_PAIRS))
def cramers_v_lines(t: Tables) -> DataFrame:
    return to_six(cramers_v(t("lineitem"), FLAGS))


@query("D20", cramers_sql("part", [("p_brand", "p_type")], corrected=False))
def cramers_v_uncorrected(t: Tables) -> DataFrame:
    return to_six(cramers_v(t("part"), ["p_brand", "p_type"], bias_correction=False))


@query("D20", ratio_sql("lineitem", MIXED_PAIRS))
def correlation_ratio_lines(t: Tables) -> DataFrame:
    return to_six(correlation_ratio(t("lineitem"), FLAGS, MEASURES))


@query("D20", pearson_sql("lineitem", list(combinations(MEASURES, 2))))
def numeric_pairs_lines(t: Tables) -> DataFrame:
    return to_six(numeric_pairs(t("lineitem"), MEASURES))


@query("D20", MATRIX_SQL)
def association_matrix_documents(t: Tables) -> DataFrame:
    matrix = association_matrix(
        judged_columns(t), ["lang", "source"], ["n_chars", "quality", "toxic"]
    )
    return to_six(matrix)


@query(
    "D21",
    f"""SELECT CASE WHEN a = 'quality' THEN b ELSE a END AS feature, round_even(value, 4) AS value
        FROM ({MATRIX_SQL}) WHERE (a = 'quality' OR b = 'quality') AND round_even(value, 4) > 0.07""",
)
def strong_associations_quality(t: Tables) -> DataFrame:
    matrix = association_matrix(
        judged_columns(t), ["lang", "source"], ["n_chars", "quality", "toxic"]
    )
    return strong_associations(to_six(matrix), "quality", scale=4)


@query(
    "D19",
    _union(
        [
            f"""SELECT '{c}' AS feature, round(corr(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, {c}),
                6) AS corr FROM lineitem"""
            for c in ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
        ]
    ),
)
def pearson_bundle(t: Tables) -> DataFrame:
    lines = t("lineitem").withColumn("label", F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    cols = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return pearson(lines, "label", cols).withColumn("corr", F.round("corr", 6))


@query(
    "D19",
    _union(
        [
            f"""SELECT '{c}' AS feature, round(corr(n_chars, {c}), 6) AS corr
                FROM documents LEFT JOIN labels USING (doc_id)"""
            for c in ("quality", "toxic")
        ]
    ),
)
def pearson_pairwise(t: Tables) -> DataFrame:
    """Documents without labels are left out."""
    docs = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id", "left")
    found = pearson(docs, "n_chars", ["quality", "toxic"])
    return found.withColumn("corr", F.round("corr", 6))


@query(
    "D19 Q4",
    _union(
        [
            f"""SELECT '{c}' AS feature, round(corr(n_chars, coalesce({c}, 0)), 6) AS corr
                FROM documents LEFT JOIN labels USING (doc_id)"""
            for c in ("quality", "toxic")
        ]
    ),
)
def pearson_null_as_zero(t: Tables) -> DataFrame:
    """Documents without labels count as 0."""
    docs = t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id", "left")
    found = pearson(docs, "n_chars", ["quality", "toxic"], nulls="zero")
    return found.withColumn("corr", F.round("corr", 6))
