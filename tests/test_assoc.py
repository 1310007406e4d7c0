import random

import numpy as np
import pytest

from evkit.operators import assoc as A
from tests.conftest import table


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        a = rng.choice("xyz")
        b = a if rng.random() < 0.5 else rng.choice("xyz")
        v = {"x": 1.0, "y": 2.0, "z": 3.0}[a] + rng.random()
        rows.append((a if i % 40 else None, b, "same", v, v * 2 if i % 10 else None, float(i)))
    return rows, table(spark, "a string, b string, c string, v double, w double, t double", rows)


def by_pair(df):
    return {(r.a, r.b): r.value for r in df.collect()}


def cramer_reference(xs, ys, corrected=True):
    xs, ys = [str(x) for x in xs], [str(y) for y in ys]
    r, c = sorted(set(xs)), sorted(set(ys))
    n = np.zeros((len(r), len(c)))
    for x, y in zip(xs, ys):
        n[r.index(x), c.index(y)] += 1
    total = n.sum()
    expected = n.sum(1, keepdims=True) @ n.sum(0, keepdims=True) / total
    phi2 = ((n - expected) ** 2 / expected).sum() / total
    rows, cols = n.shape
    if not corrected:
        return np.sqrt(phi2 / (min(rows, cols) - 1))
    phi2 = max(0, phi2 - (rows - 1) * (cols - 1) / (total - 1))
    return np.sqrt(phi2 / min(cols - (cols - 1) ** 2 / (total - 1) - 1,
                              rows - (rows - 1) ** 2 / (total - 1) - 1))


@pytest.mark.parametrize("corrected", [True, False])
def test_cramers_v(mixed, corrected):
    rows, df = mixed
    got = by_pair(A.cramers_v(df, ["a", "b", "c"], corrected))
    expected = cramer_reference([r[0] for r in rows], [r[1] for r in rows], corrected)
    assert got[("a", "b")] == pytest.approx(expected)
    assert 0 <= got[("a", "b")] <= 1
    assert got[("a", "c")] is None  # a column with one value


def test_correlation_ratio(mixed):
    rows, df = mixed
    got = by_pair(A.correlation_ratio(df, ["a", "c"], ["v", "w"]))
    for k, name in ((3, "v"), (4, "w")):
        pairs = [(str(r[0]), r[k]) for r in rows if r[k] is not None]
        y = np.array([p[1] for p in pairs])
        between = sum(
            len(g) * (np.mean(g) - y.mean()) ** 2
            for g in ([p[1] for p in pairs if p[0] == key] for key in {p[0] for p in pairs})
        )
        assert got[("a", name)] == pytest.approx(np.sqrt(between / ((y - y.mean()) ** 2).sum()))
    assert got[("c", "v")] == pytest.approx(0.0, abs=1e-6)


def test_a_category_that_decides_the_number(spark):
    df = table(spark, "a string, v double", [("x", 1.0), ("x", 1.0), ("y", 5.0)])
    assert by_pair(A.correlation_ratio(df, ["a"], ["v"]))[("a", "v")] == pytest.approx(1.0)


def test_pearson_null_policies(spark):
    rows = [(1, 1.0), (0, 4.0), (1, None), (1, 3.0), (0, 2.0)]
    df = table(spark, "y int, x double", rows)
    pairwise = A.pearson(df, "y", ["x"]).first()
    kept = [(y, x) for y, x in rows if x is not None]
    assert pairwise["corr"] == pytest.approx(np.corrcoef(*zip(*kept))[0, 1])
    zero = A.pearson(df, "y", ["x"], nulls="zero").first()
    filled = [(y, x or 0.0) for y, x in rows]
    assert zero["corr"] == pytest.approx(np.corrcoef(*zip(*filled))[0, 1])
    with pytest.raises(ValueError):
        A.pearson(df, "y", ["x"], nulls="drop")


def test_matrix_holds_every_pair_once(mixed):
    _, df = mixed
    got = by_pair(A.association_matrix(df, ["a", "b"], ["v", "w", "t"]))
    assert len(got) == 1 + 6 + 3
    assert got[("v", "w")] == pytest.approx(1.0)


def test_strong_associations(mixed):
    _, df = mixed
    matrix = A.association_matrix(df, ["a", "b"], ["v", "w"])
    strong = {r.feature: r.value for r in A.strong_associations(matrix, "v", 0.3).collect()}
    assert strong["w"] == 1.0 and "a" in strong
    assert all(v > 0.3 for v in strong.values())


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_each_measure_scans_the_table_once(spark, tmp_path, mixed):
    mixed[1].write.parquet(f"{tmp_path}/mixed")
    df = spark.read.parquet(f"{tmp_path}/mixed")
    assert scans(A.cramers_v(df, ["a", "b", "c"])) == 1
    assert scans(A.correlation_ratio(df, ["a", "b"], ["v", "w"])) == 1
    assert scans(A.numeric_pairs(df, ["v", "w", "t"])) == 1
    assert scans(A.category_sizes(df, ["a", "b", "t"])) == 1


def test_null_categories_are_no_text(spark):
    rows = [(None, "x"), (None, "x"), ("\u0000", "y"), ("\u0000", "y"), ("", "z"), ("", "z")]
    df = table(spark, "a string, b string", rows)
    assert by_pair(A.cramers_v(df, ["a", "b"], False))[("a", "b")] == pytest.approx(1.0)


def test_null_numbers_as_zero(spark):
    df = table(spark, "a string, v double, w double", [("x", 1.0, None), ("x", None, 2.0), ("y", 5.0, 3.0), (None, 4.0, 1.0)])
    filled = df.na.fill(0.0, ["v", "w"])
    for nulls, other in (("zero", filled), ("skip", df)):
        assert by_pair(A.correlation_ratio(df, ["a"], ["v"], nulls)) == by_pair(A.correlation_ratio(other, ["a"], ["v"]))
        assert by_pair(A.numeric_pairs(df, ["v", "w"], nulls)) == by_pair(A.numeric_pairs(other, ["v", "w"]))
    assert len(by_pair(A.association_matrix(df, ["a"], ["v", "w"], nulls="zero"))) == 3
    with pytest.raises(ValueError):
        A.numeric_pairs(df, ["v", "w"], "mean")


def test_columns_of_too_many_categories(mixed):
    _, df = mixed
    found = {r["column"]: r.categories for r in A.category_sizes(df, ["a", "b", "t"], 100).collect()}
    assert set(found) == {"t"} and abs(found["t"] - 400) < 40
    with pytest.raises(ValueError, match="t"):
        A.association_matrix(df, ["a", "t"], ["v"], max_categories=100)


def test_correlation_ratio_of_large_close_numbers(spark):
    rows = [("xy"[i % 2], 1e9 + (i % 2) + (i % 5) / 10) for i in range(1000)]
    got = by_pair(A.correlation_ratio(table(spark, "a string, v double", rows), ["a"], ["v"]))[("a", "v")]
    values = [(a, v - 1e9) for a, v in rows]
    small = by_pair(A.correlation_ratio(table(spark, "a string, v double", values), ["a"], ["v"]))[("a", "v")]
    assert got == pytest.approx(small, rel=1e-6)
