"""Boosted trees against a plain booster, their limits, stopping, and kept models."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evkit.operators import boosting as B
from evkit.operators import model as M
from evkit.operators.categories import category_table
from tests.conftest import rows_of, table


def plain_split(rows, g, h, min_rows, l2):
    """(gain, feature, limit) over all limits between values, the first feature and lowest limit on ties."""
    best = None
    tg, th = g[rows].sum(), h[rows].sum()
    for f in range(len(X[0])):
        values = sorted({X[i][f] for i in rows})
        for a, b in zip(values, values[1:]):
            left = [i for i in rows if X[i][f] <= a]
            right = [i for i in rows if X[i][f] > a]
            if min(len(left), len(right)) < min_rows or min(h[left].sum(), h[right].sum()) < 1e-3:
                continue
            gain = (g[left].sum() ** 2 / (h[left].sum() + l2) + g[right].sum() ** 2 / (h[right].sum() + l2)
                    - tg**2 / (th + l2))
            if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                best = (gain, f, a, left, right)
    return best


def plain_boost(y, rounds, rate, max_leaves, min_rows, l2):
    p = y.mean()
    margin = np.full(len(y), math.log(p / (1 - p)))
    sizes = []
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-margin))
        g, h = chance - y, chance * (1 - chance)
        order = 0
        leaves = {0: list(range(len(y)))}
        heap = []

        def offer(k):
            found = plain_split(leaves[k], g, h, min_rows, l2)
            if found:
                heapq.heappush(heap, (-found[0], k, found))

        offer(0)
        while heap and len(leaves) < max_leaves:
            _, k, (_, _, _, left, right) = heapq.heappop(heap)
            del leaves[k]
            for part in (left, right):
                order += 1
                leaves[order] = part
                offer(order)
        for rows in leaves.values():
            margin[rows] -= rate * g[rows].sum() / (h[rows].sum() + l2)
        sizes.append(len(leaves))
    return 1 / (1 + np.exp(-margin)), sizes


rng = random.Random(7)
CATS = ["ash", "birch", "cedar", "elm", "fir"]
RAW = [(i, rng.choice(CATS), rng.randrange(12), rng.choice([0.25, 0.5, 1.0, 4.0])) for i in range(600)]
X = [(CATS.index(c), a, b) for _, c, a, b in RAW]
Y = np.array([int(rng.random() < (0.7 if (x[0] > 2) != (x[1] > 6) else 0.2 + 0.1 * (x[2] > 0.5))) for x in X])


@pytest.fixture(scope="module")
def rows(spark):
    data = [(*r, int(y)) for r, y in zip(RAW, Y)]
    return table(spark, "id long, tree string, a int, b double, y int", data).repartition(5)


@pytest.mark.parametrize("max_leaves,min_rows,l2", [(31, 20, 1.0), (4, 5, 0.0), (8, 60, 10.0)])
def test_equals_a_plain_booster(rows, max_leaves, min_rows, l2):
    fitted = B.fit_boosted(rows, ["tree"], ["a", "b"], "y", rounds=6, rate=0.3, max_leaves=max_leaves,
                           min_rows=min_rows, l2=l2)
    got = {r.id: r.prob for r in B.score_boosted(fitted, rows).collect()}
    want, sizes = plain_boost(Y, 6, 0.3, max_leaves, min_rows, l2)
    assert [sum(n.feature < 0 for n in tree) for tree in fitted.trees] == sizes
    assert max(sizes) <= max_leaves
    assert [got[i] for i in range(len(Y))] == pytest.approx(list(want), abs=1e-9)


def test_margins_written_between_rounds_change_nothing(rows, monkeypatch):
    one = B.fit_boosted(rows, ["tree"], ["a"], "y", rounds=5, min_rows=20)
    monkeypatch.setattr(B, "REWRITE", 2)
    two = B.fit_boosted(rows, ["tree"], ["a"], "y", rounds=5, min_rows=20)
    for a, b in zip(one.trees, two.trees):
        assert [n[:4] for n in a] == [n[:4] for n in b]
        assert [n.value for n in a] == pytest.approx([n.value for n in b])


def test_patience_on_watched_rows(rows):
    watched = F.col("id") % 5 == 0
    fitted = B.fit_boosted(rows, ["tree"], ["a", "b"], "y", watched, rounds=200, rate=0.5, min_rows=5, patience=3)
    assert len(fitted.trees) < 200
    best = fitted.losses[-4]
    assert all(x >= best - B.STOP_TOLERANCE for x in fitted.losses[-3:])
    # The losses are those of the rows that were not learnt from.
    probs = [(r.y, r.prob) for r in B.score_boosted(fitted, rows.filter(watched)).collect()]
    loss = -np.mean([math.log(p if y else 1 - p) for y, p in probs])
    assert loss == pytest.approx(fitted.losses[-1])


@pytest.mark.parametrize("losses,stop", [([3, 2, 1], False), ([1, 2, 2, 2], True), ([1, 2, 2, 0.5], False), ([1, 1, 1, 1], True)])
def test_stalled(losses, stop):
    assert B._stalled(losses, 3, 1e-7) is stop


def test_many_categories_unseen_ones_and_missing_numbers(spark):
    data = [(f"c{i % 700:03d}", float(i % 900), int(i % 700 >= 350)) for i in range(6300)]
    fitted = B.fit_boosted(table(spark, "c string, v double, y int", data), ["c"], ["v"], "y", rounds=20, rate=0.5, min_rows=10)
    odd = table(spark, "c string, v double", [("c100", 1.0), ("c600", 1.0), ("zzz", 1.0), (None, None), ("c600", float("nan"))])
    got = [r.prob for r in B.score_boosted(fitted, odd).collect()]
    # Unseen categories and nulls come before all others, as the first half.
    assert got[0] < 0.1 and got[1] > 0.9 and got[2] < 0.1 and got[3] < 0.1 and got[4] > 0.9
    assert max(len(e) for e in fitted.edges) < B.MAX_BINS


def test_degenerate_inputs(spark):
    one = table(spark, "c string, y int", [("a", 1)] * 30 + [("b", None)] * 5)
    fitted = B.fit_boosted(one, ["c"], [], "y", rounds=3)
    assert not fitted.trees and B.score_boosted(fitted, one).first().prob > 0.999
    with pytest.raises(ValueError):
        B.fit_boosted(one.limit(0), ["c"], [], "y")
    with pytest.raises(ValueError):
        B.fit_boosted(one, [], [], "y")


def test_kept_models_load_elsewhere(spark, rows, tmp_path):
    boosted = B.fit_boosted(rows, ["tree"], ["a"], "y", rounds=3, min_rows=20)
    linear = M.fit(M.build_pipeline("lr", ["tree"], ["a"], "y"), rows)
    other = spark.newSession()
    for name, fitted in (("boosted", boosted), ("linear", linear)):
        path = f"{tmp_path}/{name}"
        M.save_model(fitted, rows.agg(F.avg("y")), path)
        model, base = M.load_model(other, path)
        assert base == pytest.approx(Y.mean())
        a = rows_of(M.score(fitted, rows), "id", "prob")
        assert rows_of(M.score(model, rows), "id", "prob") == a


def test_category_table_of_many_values(spark):
    df = spark.range(400_000).select(F.concat(F.lit("v"), F.col("id") % 200_000).alias("c"), (F.col("id") % 3).cast("string").alias("d"))
    df = df.withColumn("d", F.when(F.col("d") != "2", F.col("d")))
    got = category_table(df, ["c", "d"])
    sums = {r["column"]: (r.n, r.low, r.high, r.kinds) for r in got.groupBy("column").agg(
        F.count("*").alias("n"), F.min("index").alias("low"), F.max("index").alias("high"),
        F.countDistinct("index").alias("kinds")).collect()}
    assert sums == {"c": (200_000, 0.0, 199_999.0, 200_000), "d": (2, 0.0, 1.0, 2)}
    values = sorted(f"v{i}" for i in range(200_000))
    picked = {r.value: r["index"] for r in got.filter(F.col("value").isin(values[0], values[77_777], values[-1])).collect()}
    assert picked == {values[0]: 0.0, values[77_777]: 77_777.0, values[-1]: 199_999.0}
