import math
import random

import pytest
from pyspark.sql import functions as F

from evkit.operators import model as M
from evkit.operators.evaluate import (
    confusion_counts,
    confusion_matrix,
    evaluate,
    rank_auc,
)
from tests.conftest import rows_of, table


@pytest.fixture(scope="module")
def shots(spark):
    """The chance of success is 0.8 near the basket and 0.3 far from it."""
    rng = random.Random(11)
    rows = []
    for i in range(4000):
        zone = rng.choice(["near", "far"])
        p = 0.8 if zone == "near" else 0.3
        rows.append((i, zone, rng.random(), int(rng.random() < p)))
    return table(spark, "id long, zone string, skill double, made int", rows).cache()


def test_temporal_split(spark):
    df = table(spark, "g int", [(1,), (5,), (9,), (None,)])
    train, test = M.temporal_split(df, "g", 5)
    assert rows_of(train) == [(1,), (5,)] and rows_of(test) == [(9,)]


@pytest.mark.parametrize("mode", ["hash", "exact"])
def test_stratified_split(shots, mode):
    train, test = M.stratified_split(shots, "id", "made", 0.2, mode=mode)
    assert train.join(test, "id").count() == 0
    assert train.count() + test.count() == shots.count()
    assert train.columns == test.columns == shots.columns
    sizes = {r.made: r["count"] for r in shots.groupBy("made").count().collect()}
    for r in test.groupBy("made").count().collect():
        if mode == "exact":
            assert r["count"] == round(sizes[r.made] * 0.2)
        else:
            assert abs(r["count"] / sizes[r.made] - 0.2) < 0.05
    again = M.stratified_split(shots.repartition(7), "id", "made", 0.2, mode=mode)[1]
    assert rows_of(again, "id") == rows_of(test, "id")


def test_exact_split_of_many_classes_reads_the_rows_twice(spark):
    df = spark.range(5000).select("id", (F.col("id") % 250).alias("y"))
    marked = M.stratified_part(df, "id", "y", 0.2, mode="exact")
    sizes = marked.filter("part = 'test'").groupBy("y").count().collect()
    assert len(sizes) == 250 and {r["count"] for r in sizes} == {4}
    assert marked._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 5000") == 1


def test_exact_split_of_tiny_classes(spark):
    df = table(spark, "id int, y string", [(i, "a") for i in range(10)] + [(99, "b"), (98, None)])
    train, test = M.stratified_split(df, "id", "y", 0.2, mode="exact")
    assert test.filter("y = 'a'").count() == 2
    assert rows_of(train.filter("y = 'b'")) == [(99, "b")]
    assert train.count() + test.count() == 11


def test_string_index_order(spark):
    df = table(spark, "z string", [("b",), ("b",), ("c",), ("a",)])
    got = rows_of(M.string_index(df, ["z"]), "index", "value")
    assert got == [(0.0, "b"), (1.0, "a"), (2.0, "c")]


def test_ordinal_encode_unknown_and_null(spark):
    train = table(spark, "z string", [("b",), ("a",)])
    df = table(spark, "z string", [("a",), ("b",), ("new",), (None,)])
    got = {r.z: r.z_code for r in M.ordinal_encode(train, df, ["z"]).collect()}
    assert got == {"a": 0.0, "b": 1.0, "new": -1.0, None: -1.0}


def test_logistic_recovers_the_rates(shots):
    train, test = M.stratified_split(shots, "id", "made")
    model = M.build_pipeline("lr", ["zone"], ["skill"], "made").fit(train)
    scored = M.score(model, test)
    means = {r.zone: r.p for r in scored.groupBy("zone").agg(F.avg("prob").alias("p")).collect()}
    assert means["near"] == pytest.approx(0.8, abs=0.05)
    assert means["far"] == pytest.approx(0.3, abs=0.05)
    assert scored.columns == [*shots.columns, "prediction", "prob"]


def test_unseen_categories_and_null_numbers(spark, shots):
    model = M.build_pipeline("lr", ["zone"], ["skill"], "made", invalid_numbers="skip").fit(shots)
    odd = table(spark, "id long, zone string, skill double, made int",
                [(1, "moon", 0.5, 0), (2, None, 0.5, 0), (3, "near", None, 0)])
    assert rows_of(M.score(model, odd), "id") == [(1,), (2,)]


@pytest.mark.parametrize("kind,params", [("gbt", {"rounds": 30}), ("rf", {"numTrees": 5}), ("lr", {})])
def test_all_kinds_of_models(shots, kind, params):
    model = M.train_model(kind, shots, ["zone"], ["skill"], "made", F.col("id") % 10 == 0, **params)
    means = {r.zone: r.p for r in
             M.score(model, shots).groupBy("zone").agg(F.avg("prob").alias("p")).collect()}
    assert means["near"] > means["far"] + 0.2


def test_forests_take_any_number_of_categories(spark):
    df = table(spark, "c string, y int", [(f"c{i % 400:03d}", int(i % 400 > 200)) for i in range(4000)])
    scored = M.score(M.train_model("rf", df, ["c"], [], "y", numTrees=3), df)
    assert scored.filter("prediction = y").count() > 3900


def test_unknown_kind():
    for build in (M.build_pipeline, lambda kind: M.train_model(kind, None, [], [], "y")):
        with pytest.raises(ValueError):
            build("deep")


def test_coefficients_have_their_own_names(shots):
    model = M.fit(M.build_pipeline("lr", ["zone"], ["skill"], "made"), shots)
    got = {r.name: r.coefficient for r in M.coefficients(model, shots).collect()}
    counts = {r.zone: r["count"] for r in shots.groupBy("zone").count().collect()}
    top = max(sorted(counts), key=counts.get)
    # The less frequent zone is the reference level: one slot for two zones.
    assert set(got) == {"intercept", "skill", f"zone_encoded_{top}"}
    assert (got[f"zone_encoded_{top}"] > 0) == (top == "near")


LEVELS = [("a", 1)] * 30 + [("a", 0)] * 10 + [("b", 1)] * 10 + [("b", 0)] * 20 + [("c", 1)] * 5 + [("c", 0)] * 15


def test_reference_level_and_unknown_are_the_zero_vector(spark):
    df = table(spark, "z string, y int", LEVELS)
    model = M.fit(M.build_pipeline("lr", ["z"], [], "y", tol=1e-14, maxIter=500), df)
    got = {r.name: r.coefficient for r in M.coefficients(model, df).collect()}
    logit = lambda p: math.log(p / (1 - p))
    want = {"intercept": logit(0.25), "z_encoded_a": logit(0.75) - logit(0.25), "z_encoded_b": logit(1 / 3) - logit(0.25)}
    assert got == pytest.approx(want, abs=1e-4)
    odd = table(spark, "z string, y int", [("c", 0), ("new", 0), (None, 0)])
    vectors = [r.features.toArray().tolist() for r in model.transform(odd).collect()]
    assert vectors == [[0.0, 0.0]] * 3


def test_encoder_of_several_columns(spark):
    rows = [(f"a{i % 3}", f"b{i % 4}", "same", float(i)) for i in range(24)]
    df = table(spark, "a string, b string, c string, v double", rows)
    out = M.ReferenceEncoder(["a", "b", "c"], ["v"]).fit(df).transform(df)
    attrs = out.schema["features"].metadata["ml_attr"]["attrs"]
    names = [a["name"] for a in sorted((a for g in attrs.values() for a in g), key=lambda a: a["idx"])]
    assert names == ["v", "a_encoded_a0", "a_encoded_a1", "b_encoded_b0", "b_encoded_b1", "b_encoded_b2"]
    with pytest.raises(ValueError):
        M.ReferenceEncoder(["c"]).fit(df)


def test_equal_rows_as_one_weighted_row_give_the_same_fit(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xyz"), rng.randrange(3), int(rng.random() < 0.4)) for _ in range(3000)]
    df = table(spark, "z string, v int, y int", rows)
    fits = [M.fit(M.build_pipeline("lr", ["z"], ["v"], "y", tol=1e-12), df, compress=c) for c in (True, False)]
    one, two = ({r.name: r.coefficient for r in M.coefficients(m, df).collect()} for m in fits)
    assert one == pytest.approx(two, abs=1e-6)
    assert M.compressed(df, ["z", "v", "y"]).count() <= 18


def test_scenarios(spark, shots):
    model = M.build_pipeline("lr", ["zone"], ["skill"], "made").fit(shots)
    scenarios = table(spark, "zone string, skill double, value int", [("near", 0.5, 2), ("far", 0.5, 3)])
    got = M.score_scenarios(model, scenarios, "value", 0.5).collect()
    for r in got:
        assert r.xp == pytest.approx(r.value * r.prob)
        assert r.lift == pytest.approx(r.prob / 0.5)
    flat = M.score_scenarios(model, scenarios, "value", 0.0)
    assert [r.lift for r in flat.collect()] == [1.0, 1.0]


def test_compare_models(shots):
    train, test = M.stratified_split(shots, "id", "made")
    got = M.compare_models(train, test, ["zone"], ["skill"], "made",
                           settings={"gbt": {"rounds": 40}, "rf": {"numTrees": 3}})
    rows = {r.model: r for r in got.collect()}
    assert set(rows) == {"lr", "gbt", "rf"}
    for r in rows.values():
        assert r.tp + r.fp + r.tn + r.fn == test.count()
        assert 0.65 < r.auc < 0.85 and 0.6 < r.accuracy < 0.9


SCORED = [(1, 0.9, 1.0), (1, 0.4, 0.0), (0, 0.4, 0.0), (0, 0.6, 1.0), (0, 0.1, 0.0), (1, 0.8, 1.0)]


def test_metrics_by_hand(spark):
    df = table(spark, "y int, p double, g double", SCORED)
    assert tuple(confusion_counts(df, "y", "g").first()) == (2, 1, 2, 1)
    assert rows_of(confusion_matrix(df, "y", "g")) == [(0, 2, 1), (1, 1, 2)]
    r = evaluate(df, "y", "p", "g").first()
    assert (r.accuracy, r.precision, r.recall) == pytest.approx((4 / 6, 2 / 3, 2 / 3))
    wins = sum((a > b) + (a == b) / 2 for y, a, _ in SCORED if y for z, b, _ in SCORED if not z)
    assert r.auc == pytest.approx(wins / 9)


@pytest.mark.parametrize("rows_per_task", [5_000_000, 3])
def test_metrics_of_several_models_in_one_pass(spark, rows_per_task):
    rng = random.Random(8)
    rows = [(m, int(rng.random() < 0.5), round(rng.random(), 1), float(rng.random() < 0.5)) for m in "abc" for _ in range(80)]
    rows += [("a", None, 0.5, 1.0), ("a", 1, None, 0.0)]
    df = table(spark, "m string, y int, p double, g double", rows)
    got = {r.m: r for r in evaluate(df, "y", "p", "g", ["m"], rows_per_task).collect()}
    for m in "abc":
        own = df.filter(F.col("m") == m)
        tp, fp, tn, fn = confusion_counts(own, "y", "g").first()
        assert (got[m].tp, got[m].fp, got[m].tn, got[m].fn) == (tp, fp, tn, fn)
        assert got[m].auc == pytest.approx(rank_auc(own, "y", "p").first().auc)


@pytest.mark.parametrize("rows_per_task", [5_000_000, 7, 1])
def test_auc_matches_pairs_and_mirrors(spark, rows_per_task):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(300)]
    df = table(spark, "y int, p double", rows)
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    expected = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    got = rank_auc(df, "y", "p", rows_per_task).first().auc
    assert got == pytest.approx(expected)
    mirrored = df.withColumn("p", 1 - F.col("p"))
    assert rank_auc(mirrored, "y", "p", rows_per_task).first().auc == pytest.approx(1 - expected)


def test_auc_of_one_class_is_null(spark):
    df = table(spark, "y int, p double", [(1, 0.5), (1, 0.7)])
    assert rank_auc(df, "y", "p").first().auc is None
