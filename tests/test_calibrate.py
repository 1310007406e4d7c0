"""Reliability and isotonic regression against plain versions."""

import random

import pytest

from evkit.operators import calibrate as C
from tests.conftest import rows_of, table


def plain_isotonic(rows):
    """Least-squares rising rates per distinct score, by the min-max formula."""
    cells = {}
    for y, p in rows:
        n, hits = cells.get(p, (0, 0))
        cells[p] = (n + 1, hits + y)
    scores = sorted(cells)
    counts = [cells[s] for s in scores]

    def mean(j, k):
        return sum(h for _, h in counts[j:k + 1]) / sum(n for n, _ in counts[j:k + 1])

    return {s: max(min(mean(j, k) for k in range(i, len(scores))) for j in range(i + 1)) for i, s in enumerate(scores)}


def sample(shape, n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        p = rng.randrange(60) / 60
        rate = {"rising": p, "falling": 1 - p, "flat": 0.4, "wave": abs(p * 4 % 2 - 1)}[shape]
        rows.append((int(rng.random() < rate), p))
    return rows


@pytest.mark.parametrize("shape", ["rising", "falling", "flat", "wave"])
@pytest.mark.parametrize("per_task", [100_000, 8, 3])
def test_isotonic_equals_the_plain_fit(spark, shape, per_task):
    rows = sample(shape, 500, 1)
    df = table(spark, "y int, p double", [*rows, (None, 0.5), (1, None)]).repartition(4)
    pools = C.isotonic_fit(df, "y", "p", per_task)
    got = pools.orderBy("low").collect()
    assert all(a.rate < b.rate and a.high < b.low for a, b in zip(got, got[1:]))
    assert sum(r.rows for r in got) == len(rows)
    scored = C.isotonic_score(df.filter("p IS NOT NULL"), pools, "p")
    want = plain_isotonic(rows)
    for r in scored.collect():
        assert r.calibrated == pytest.approx(want[r.p])


def test_a_long_chain_of_violations_is_one_pool(spark):
    """One high rate first, then slowly rising ones that stay below it: pooled across all blocks."""
    rows = [(1, 0.0)] * 1000 + [(int(i < s), s / 100) for s in range(1, 60) for i in range(100)]
    df = table(spark, "y int, p double", rows)
    one = rows_of(C.isotonic_fit(df, "y", "p"), "low", "high", "rows", "hits")
    assert rows_of(C.isotonic_fit(df, "y", "p", 4), "low", "high", "rows", "hits") == one


def test_scores_outside_and_between_pools(spark):
    df = table(spark, "y int, p double", [(0, 0.2), (0, 0.2), (1, 0.4), (0, 0.4), (1, 0.8)])
    pools = C.isotonic_fit(df, "y", "p")
    asked = table(spark, "p double", [(0.0,), (0.2,), (0.3,), (0.4,), (0.79,), (0.8,), (1.0,), (None,)])
    got = {r.p: r.calibrated for r in C.isotonic_score(asked, pools, "p").collect()}
    assert got == {0.0: 0.0, 0.2: 0.0, 0.3: 0.0, 0.4: 0.5, 0.79: 0.5, 0.8: 1.0, 1.0: 1.0, None: None}


def test_empty_input(spark):
    empty = table(spark, "y int, p double", [])
    assert C.isotonic_fit(empty, "y", "p").count() == 0
    assert C.reliability(empty, "y", "p").count() == 0
    assert tuple(C.calibration_error(empty, "y", "p").first()) == (None, None)


def test_reliability_by_hand(spark):
    rows = [(1, 0.05), (0, 0.05), (1, 0.95), (1, 1.0), (None, 0.5), (0, None), (0, 0.3)]
    df = table(spark, "y int, p double", rows)
    got = {r.bin: (r.rows, round(r.mean_prob, 9), r.rate, round(r.gap, 9)) for r in C.reliability(df, "y", "p").collect()}
    assert got == {0: (2, 0.05, 0.5, 0.45), 3: (1, 0.3, 0.0, -0.3), 9: (2, 0.975, 1.0, 0.025)}
    error = C.calibration_error(df, "y", "p").first()
    assert error.expected_error == pytest.approx((2 * 0.45 + 0.3 + 2 * 0.025) / 5) and error.largest_error == pytest.approx(0.45)
