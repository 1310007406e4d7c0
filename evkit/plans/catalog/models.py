"""Model queries: splits, encoders, metrics and fitted models on labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evkit.operators.boosting import fit_boosted
from evkit.operators.calibrate import isotonic_fit, isotonic_score, reliability
from evkit.operators.evaluate import confusion_counts, confusion_matrix, evaluate, rank_auc
from evkit.operators.model import (
    build_pipeline,
    coefficients,
    compare_models,
    fit,
    lift,
    load_model,
    ordinal_encode,
    save_model,
    score,
    score_scenarios,
    string_index,
    stratified_part,
    stratified_split,
    temporal_split,
)
from evkit.operators.joins import denormalize
from evkit.operators.value import expected_value, over_under_games, summarize_games
from evkit.plans.catalog.registry import Tables, query
from evkit.plans.catalog.shared import judged_documents, order_owners
from evkit.session import scratch_path

CATS = ["lang", "source"]
NUMS = ["n_chars"]
LONG_TEXT = 800
LABELLED_SQL = f"""
    SELECT quality, n_chars AS score, CASE WHEN n_chars > {LONG_TEXT} THEN 1 ELSE 0 END AS pred
    FROM documents JOIN labels USING (doc_id)"""
SPLIT_HASH_SQL = """
    SELECT doc_id, quality, md5(doc_id::VARCHAR || ':42') AS h,
           ('0x' || substr(md5(doc_id::VARCHAR || ':42'), 1, 5))::INTEGER AS bucket
    FROM documents JOIN labels USING (doc_id)"""


def auc_sql(rows: str) -> str:
    return f"""
    SELECT (sum(CASE WHEN y = 1 THEN r + (ties - 1) / 2.0 ELSE 0 END) - p * (p + 1) / 2) / (p * n)
           AS auc
    FROM (SELECT y, rank() OVER (ORDER BY s) AS r, count(*) OVER (PARTITION BY s) AS ties,
                 (sum(y) OVER ())::DOUBLE AS p, (count(*) OVER () - sum(y) OVER ())::DOUBLE AS n
          FROM ({rows})) GROUP BY p, n"""


def judged_scores(t: Tables) -> DataFrame:
    """Text length as the score, a length threshold as the prediction."""
    return judged_documents(t).select(
        "quality",
        F.col("n_chars").alias("score"),
        F.when(F.col("n_chars") > LONG_TEXT, 1).otherwise(0).alias("pred"),
    )


@query(
    "L4",
    """SELECT CASE WHEN o_orderkey <= 7500 THEN 'train' ELSE 'test' END AS part, count(*) AS rows,
              min(o_orderkey) AS lowest, max(o_orderkey) AS highest FROM orders GROUP BY part""",
)
def temporal_split_parts(t: Tables) -> DataFrame:
    train, test = temporal_split(t("orders"), "o_orderkey", 7500)
    both = train.select(F.lit("train").alias("part"), "o_orderkey").unionByName(
        test.select(F.lit("test").alias("part"), "o_orderkey")
    )
    return both.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("o_orderkey").alias("lowest"),
        F.max("o_orderkey").alias("highest"),
    )


@query(
    "L5",
    f"""SELECT doc_id, CASE WHEN bucket < 209715 THEN 'test' ELSE 'train' END AS part
        FROM ({SPLIT_HASH_SQL})""",
)
def stratified_split_by_hash(t: Tables) -> DataFrame:
    return stratified_part(judged_documents(t), "doc_id", "quality", 0.2).select("doc_id", "part")


@query(
    "L5",
    f"""SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY h, doc_id)
                            <= round(count(*) OVER (PARTITION BY quality) * 0.2) THEN 'test'
                            ELSE 'train' END AS part
        FROM ({SPLIT_HASH_SQL})""",
)
def stratified_split_exact(t: Tables) -> DataFrame:
    docs = judged_documents(t)
    return stratified_part(docs, "doc_id", "quality", 0.2, mode="exact").select("doc_id", "part")


@query(
    "L1",
    """
    WITH counts AS (SELECT 'p_type' AS "column", p_type AS value, count(*) AS n FROM part GROUP BY ALL
                    UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY ALL)
    SELECT "column", value,
           (row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) - 1)::DOUBLE AS index
    FROM counts""",
)
def category_indexes(t: Tables) -> DataFrame:
    return string_index(t("part"), ["p_type", "p_brand"])


@query(
    "L8",
    """
    WITH known AS (SELECT p_type, (row_number() OVER (ORDER BY p_type) - 1)::DOUBLE AS code
                   FROM (SELECT DISTINCT p_type FROM part WHERE p_type < 'P'))
    SELECT p_partkey, coalesce(code, -1) AS p_type_code FROM part LEFT JOIN known USING (p_type)""",
)
def ordinal_codes(t: Tables) -> DataFrame:
    """Types from P on are unseen in training."""
    parts = t("part").select("p_partkey", "p_type")
    coded = ordinal_encode(parts.filter("p_type < 'P'"), parts, ["p_type"])
    return coded.select("p_partkey", "p_type_code")


@query(
    "L11 L12 L13 L14",
    f"""
    SELECT (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy,
           tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall,
           auc, tp, fp, tn, fn
    FROM (SELECT count(*) FILTER (quality = 1 AND pred = 1) AS tp,
                 count(*) FILTER (quality = 0 AND pred = 1) AS fp,
                 count(*) FILTER (quality = 0 AND pred = 0) AS tn,
                 count(*) FILTER (quality = 1 AND pred = 0) AS fn FROM ({LABELLED_SQL})),
         ({auc_sql(f"SELECT quality AS y, score AS s FROM ({LABELLED_SQL})")})""",
)
def length_metrics(t: Tables) -> DataFrame:
    return evaluate(judged_scores(t), "quality", "score", "pred")


@query(
    "L11",
    f"""SELECT round(auc, 9) AS auc FROM ({auc_sql(
        "SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_extendedprice AS s FROM lineitem"
    )})""",
)
def price_auc(t: Tables) -> DataFrame:
    lines = t("lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned"), "l_extendedprice"
    )
    return rank_auc(lines, "returned", "l_extendedprice").select(F.round("auc", 9).alias("auc"))


@query(
    "L13",
    f"""SELECT quality AS label, count(*) FILTER (pred = 0) AS pred_0,
               count(*) FILTER (pred = 1) AS pred_1 FROM ({LABELLED_SQL}) GROUP BY quality""",
)
def length_confusion(t: Tables) -> DataFrame:
    return confusion_matrix(judged_scores(t), "quality", "pred")


@query(
    "L13 L14",
    f"""SELECT count(*) FILTER (quality = 1 AND pred = 1) AS tp,
               count(*) FILTER (quality = 0 AND pred = 1) AS fp,
               count(*) FILTER (quality = 0 AND pred = 0) AS tn,
               count(*) FILTER (quality = 1 AND pred = 0) AS fn FROM ({LABELLED_SQL})""",
)
def length_confusion_counts(t: Tables) -> DataFrame:
    return confusion_counts(judged_scores(t), "quality", "pred")


@query(
    "D23",
    """SELECT l_suppkey, round(avg(r) / (SELECT avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)
                                         FROM lineitem), 6) AS lift
       FROM (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS r FROM lineitem)
       GROUP BY l_suppkey""",
)
def return_lift(t: Tables) -> DataFrame:
    returned = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    lines = t("lineitem").select("l_suppkey", returned.alias("r"))
    base = lines.agg(F.avg("r").alias("base")).scalar()
    rates = lines.groupBy("l_suppkey").agg(F.avg("r").alias("rate"))
    return rates.select("l_suppkey", F.round(lift("rate", base), 6).alias("lift"))


def quality_split(t: Tables) -> tuple[DataFrame, DataFrame]:
    return stratified_split(judged_documents(t), "doc_id", "quality", 0.2)


@query("L2 L3 L6 L7 B22")
def logistic_scores(t: Tables) -> DataFrame:
    train, test = quality_split(t)
    model = fit(build_pipeline("lr", CATS, NUMS, "quality"), train)
    return score(model, test)


def watched() -> Column:
    """A tenth of the documents, which decides when boosting stops."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0


@query("L8 L9 L7")
def boosted_scores(t: Tables) -> DataFrame:
    train, test = quality_split(t)
    return score(fit_boosted(train, CATS, NUMS, "quality", watched()), test)


@query("L15")
def logistic_coefficients(t: Tables) -> DataFrame:
    train, _ = quality_split(t)
    model = fit(build_pipeline("lr", CATS, NUMS, "quality"), train)
    return coefficients(model, train)


@query("L16 D23 B19 B21")
def scenario_scores(t: Tables) -> DataFrame:
    """Every (lang, source) that occurs, at its mean length."""
    docs = judged_documents(t)
    model = fit(build_pipeline("lr", CATS, NUMS, "quality"), docs)
    scenarios = docs.groupBy(*CATS).agg(F.avg("n_chars").alias("n_chars"))
    base = docs.agg(F.avg("quality").alias("base")).scalar()
    return score_scenarios(model, scenarios, F.lit(3), base)


@query("L17 L11 L12 L14")
def model_comparison(t: Tables) -> DataFrame:
    train, test = quality_split(t)
    return compare_models(train, test, CATS, NUMS, "quality", watched=watched())


# Fits with closed forms. The label is a returned line, the levels are those of one column or a few: then the fitted
# numbers follow from the rates of the levels, and SQL can say what they are.
RETURN_SQL = """
    SELECT l_orderkey, l_linestatus, l_linenumber::VARCHAR AS line, l_quantity,
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned FROM lineitem"""
# The fit goes on until no digit that is compared can change.
EXACT = {"tol": 1e-14, "maxIter": 500}


def returns(t: Tables) -> DataFrame:
    return t("lineitem").select(
        "l_orderkey", "l_linestatus", F.col("l_linenumber").cast("string").alias("line"), "l_quantity",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned"))


@query(
    "L2 L3 L6 L7 B22",
    f"""SELECT 'l_linestatus' AS "column", l_linestatus AS level, count(*) AS rows, round(avg(returned), 5) AS mean_prob
        FROM ({RETURN_SQL}) GROUP BY l_linestatus
        UNION ALL SELECT 'line', line, count(*), round(avg(returned), 5) FROM ({RETURN_SQL}) GROUP BY line""",
)
def logistic_level_means(t: Tables) -> DataFrame:
    """At the maximum of the likelihood, the mean probability over each one-hot level is its mean label."""
    rows = returns(t)
    model = fit(build_pipeline("lr", ["l_linestatus", "line"], ["l_quantity"], "returned", **EXACT), rows)
    scored = score(model, rows)
    levels = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("level")) for c in ("l_linestatus", "line")])
    each = scored.select("prob", F.explode(levels).alias("of")).select("of.*", "prob")
    return each.groupBy("column", "level").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("prob"), 5).alias("mean_prob"))


LEVEL_SQL = f"""
    SELECT line, count(*) AS n, avg(returned) AS rate, ln(avg(returned) / (1 - avg(returned))) AS logit,
           row_number() OVER (ORDER BY count(*) DESC, line) - 1 AS slot, count(*) OVER () AS levels
    FROM ({RETURN_SQL}) GROUP BY line"""


@query(
    "L2 L15",
    f"""WITH levels AS ({LEVEL_SQL}),
             reference AS (SELECT logit FROM levels WHERE slot = levels - 1)
        SELECT -1 AS slot, 'intercept' AS name, round(logit, 4) AS coefficient FROM reference
        UNION ALL
        SELECT slot::INTEGER, 'line_encoded_' || line, round(l.logit - r.logit, 4) FROM levels l, reference r
        WHERE slot < levels - 1""",
)
def logistic_level_coefficients(t: Tables) -> DataFrame:
    """With one column of levels, a coefficient is the difference of two log odds, and the intercept the reference's."""
    rows = returns(t)
    model = fit(build_pipeline("lr", ["line"], [], "returned", **EXACT), rows)
    return coefficients(model, rows).withColumn("coefficient", F.round("coefficient", 4))


@query(
    "L16 D23 B19 B21 L7",
    f"""SELECT line, round(rate, 5) AS prob, round(3 * rate, 4) AS xp,
               round(rate / (SELECT avg(returned) FROM ({RETURN_SQL})), 4) AS lift FROM ({LEVEL_SQL})""",
)
def kept_model_scenarios(t: Tables) -> DataFrame:
    """A model is fitted, kept, loaded and asked for one scenario per level."""
    rows = returns(t)
    path = scratch_path(t.spark, "kept-model")
    fitted = fit(build_pipeline("lr", ["line"], [], "returned", **EXACT), rows)
    save_model(fitted, rows.agg(F.avg("returned")), path)
    model, base_rate = load_model(t.spark, path)
    scored = score_scenarios(model, rows.select("line").distinct(), F.lit(3), base_rate)
    return scored.select("line", F.round("prob", 5).alias("prob"), F.round("xp", 4).alias("xp"),
                         F.round("lift", 4).alias("lift"))


BOOSTED_ROUNDS = 30


@query(
    "L8 L9 L7",
    f"""WITH RECURSIVE levels AS (
            SELECT l_linestatus, count(*)::DOUBLE AS n, sum(returned)::DOUBLE AS pos FROM ({RETURN_SQL}) GROUP BY 1),
        boosted AS (
            SELECT l_linestatus, n, pos, 0 AS round, ln(sum(pos) OVER () / (sum(n) OVER () - sum(pos) OVER ())) AS f
            FROM levels
            UNION ALL
            SELECT l_linestatus, n, pos, round + 1,
                   f - 0.06 * (n / (1 + exp(-f)) - pos) / (n / (1 + exp(-f)) * (1 - 1 / (1 + exp(-f))) + 1)
            FROM boosted WHERE round < {BOOSTED_ROUNDS})
        SELECT l_linestatus, n::BIGINT AS rows, round(1 / (1 + exp(-f)), 6) AS prob FROM boosted
        WHERE round = {BOOSTED_ROUNDS}""",
)
def boosted_levels(t: Tables) -> DataFrame:
    """With two levels every tree is one split, so a round is one Newton step per level, as the recursion has it."""
    rows = returns(t)
    model = fit_boosted(rows, ["l_linestatus"], [], "returned", rounds=BOOSTED_ROUNDS)
    scored = score(model, rows).groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("rows"), F.max("prob").alias("prob"))
    return scored.withColumn("prob", F.round("prob", 6))


# Orders up to here train, later ones are held out; the rates of the training part score the others.
LAST_TRAINING_ORDER = 1000
RATES_SQL = f"""
    WITH lines AS ({RETURN_SQL}),
    rates AS (SELECT l_linestatus, avg(returned) AS rate FROM lines WHERE l_orderkey <= {LAST_TRAINING_ORDER} GROUP BY 1)"""


@query(
    "L17 L11 L12 L13 L14",
    f"""{RATES_SQL},
        scored AS (SELECT returned AS y, rate AS s, rate > 0.5 AS pred FROM lines JOIN rates USING (l_linestatus)
                   WHERE l_orderkey > {LAST_TRAINING_ORDER}),
        found AS (
            SELECT count(*) FILTER (y = 1 AND pred) AS tp, count(*) FILTER (y = 0 AND pred) AS fp,
                   count(*) FILTER (y = 0 AND NOT pred) AS tn, count(*) FILTER (y = 1 AND NOT pred) AS fn FROM scored)
        SELECT model, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 9) AS accuracy,
               round(tp / nullif(tp + fp, 0)::DOUBLE, 9) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 9) AS recall,
               round(auc, 9) AS auc, tp, fp, tn, fn
        FROM found, ({auc_sql("SELECT y, s FROM scored")}), (VALUES ('lr'), ('gbt')) AS m(model)""",
)
def level_model_comparison(t: Tables) -> DataFrame:
    """Both models rank the two levels by their rates, so their metrics follow from the rates."""
    train, test = temporal_split(returns(t), "l_orderkey", LAST_TRAINING_ORDER)
    found = compare_models(train, test, ["l_linestatus"], [], "returned", ["lr", "gbt"], settings={"gbt": {"rounds": 40}})
    return found.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "auc")})


@query(
    "L4 L6 L7 B22 B18 B20 B21 D3 B23 D5 D7 F3",
    f"""{RATES_SQL},
        games AS (
            SELECT l_orderkey, n_name AS team, sum(value * rate) AS total_xp, sum(value * returned) AS total_pts
            FROM (SELECT l_orderkey, l_linestatus, CASE WHEN l_linestatus = 'O' THEN 3 ELSE 2 END AS value,
                         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned FROM lineitem)
            JOIN rates USING (l_linestatus)
            LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
            LEFT JOIN nation ON c_nationkey = n_nationkey
            WHERE l_orderkey > {LAST_TRAINING_ORDER} GROUP BY l_orderkey, n_name),
        teams AS (
            SELECT team, count(*) FILTER (total_pts > total_xp) AS outperform,
                   count(*) FILTER (NOT total_pts > total_xp) AS underperform FROM games GROUP BY team)
        SELECT *, outperform + underperform AS total, round(outperform * 100.0 / (outperform + underperform), 0)::DOUBLE AS outperform_pct,
               rank() OVER (ORDER BY outperform * 1.0 / (outperform + underperform) DESC) AS place FROM teams""",
)
def season_over_under(t: Tables) -> DataFrame:
    """The whole job: fit on earlier orders, score later ones, expected and actual value per order, and the nations
    ranked by how often they beat expectation."""
    lines = returns(t)
    train, test = temporal_split(lines, "l_orderkey", LAST_TRAINING_ORDER)
    model = fit(build_pipeline("lr", ["l_linestatus"], [], "returned", **EXACT), train)
    value = F.when(F.col("l_linestatus") == "O", 3).otherwise(2)
    valued = expected_value(score(model, test), value, "prob", "returned")
    games = over_under_games(valued.withColumnRenamed("l_orderkey", "line_game"), "line_game")
    games = denormalize(games, [(order_owners(t).select("game", "team"), {"line_game": "game"}, "")])
    teams = summarize_games(games, "team", scale=None).select("team", "outperform", "underperform", "total", "outperform_pct")
    # One row per nation.
    best = Window.orderBy(F.col("outperform_pct").desc())
    return teams.withColumns({"place": F.rank().over(best).cast("long"), "outperform_pct": F.round("outperform_pct")})


CALIBRATED_SQL = """
    SELECT l_quantity / 64 AS prob, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS hits
    FROM lineitem GROUP BY 1"""


def quantity_scores(t: Tables) -> DataFrame:
    """Quantity as a probability of return, which it is not: what calibration is for."""
    return t("lineitem").select(
        (F.col("l_quantity") / 64).alias("prob"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned"))


@query(
    "L11",
    f"""SELECT least(floor(prob * 10), 9)::INTEGER AS bin, sum(n)::BIGINT AS rows, round(sum(prob * n) / sum(n), 9) AS mean_prob,
               round(sum(hits) / sum(n), 9) AS rate, round(sum(hits) / sum(n) - sum(prob * n) / sum(n), 9) AS gap
        FROM ({CALIBRATED_SQL}) GROUP BY 1""",
)
def reliability_table(t: Tables) -> DataFrame:
    found = reliability(quantity_scores(t), "returned", "prob")
    return found.withColumns({c: F.round(c, 9) for c in ("mean_prob", "rate", "gap")})


@query(
    "L11",
    f"""WITH cells AS (SELECT *, row_number() OVER (ORDER BY prob) AS i FROM ({CALIBRATED_SQL})),
        sums AS (SELECT i, prob, n, sum(n) OVER (ORDER BY i) AS cn, sum(hits) OVER (ORDER BY i) AS ch FROM cells),
        ends AS (SELECT i, prob, n, cn, ch, coalesce(lag(cn) OVER (ORDER BY i), 0) AS bn, coalesce(lag(ch) OVER (ORDER BY i), 0) AS bh FROM sums),
        -- The isotonic value: over all starts up to i, the largest of the least means of runs that reach i.
        runs AS (SELECT a.i AS j, b.i AS k, (b.ch - a.bh)::DOUBLE / (b.cn - a.bn) AS mean FROM ends a JOIN ends b ON a.i <= b.i),
        lows AS (SELECT j, k AS i, min(mean) OVER (PARTITION BY j ORDER BY k DESC) AS low FROM runs)
        SELECT c.prob, c.n AS rows, round(max(low), 9) AS calibrated FROM lows JOIN cells c USING (i) GROUP BY c.prob, c.n""",
)
def isotonic_rates(t: Tables) -> DataFrame:
    scored = quantity_scores(t)
    cells = scored.groupBy("prob").agg(F.count(F.lit(1)).alias("rows"))
    calibrated = isotonic_score(cells, isotonic_fit(scored, "returned", "prob"), "prob")
    return calibrated.withColumn("calibrated", F.round("calibrated", 9))
