import random

import pytest
from pyspark.sql import functions as F

from evkit.operators.blocks import ordered_blocks
from evkit.operators.windows import running_tallies
from tests.conftest import rows_of, table

SCHEMA = "game int, player int, q int, left int, id int, made boolean"
ORDER = ["q", "-left"]


def tallies(df, mode="corrected", **kwargs):
    return running_tallies(df, "game", "player", ORDER, "made", ["id"], mode, **kwargs)


def brute_force(rows, mode):
    """The definition, attempt by attempt."""
    out = {}
    for game in {r[0] for r in rows}:
        played = sorted((r for r in rows if r[0] == game), key=lambda r: (r[2], -r[3], r[4]))
        for i, r in enumerate(played):
            own = [x for x in played[:i] if x[1] == r[1]]
            if mode == "corrected":
                taken, made = len(own), sum(bool(x[5]) for x in own)
                prev = int(bool(own[-1][5])) if own else None
                rate = made / taken if taken else None
                out[r[4]] = (i + 1, taken, made, prev, rate)
            else:
                upto = [x for x in played if x[1] == r[1] and (x[2], -x[3]) <= (r[2], -r[3])]
                taken = sum(x[1] is not None for x in played[: i + 1]) - 1
                made = sum(bool(x[5]) for x in played[: i + 1]) - 1
                if r[1] is not None and len(upto) == 1:
                    taken, made = 0, 0
                out[r[4]] = (i + 1, taken, made)
    return out


def random_rows(n=300, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        game = 1 if rng.random() < 0.4 else rng.randint(2, 6)
        player = None if rng.random() < 0.05 else rng.randint(1, 9)
        rows.append((game, player, rng.randint(1, 4), rng.randint(0, 8), i,
                     rng.choice([True, False, None])))
    return rows


def by_id(df, mode):
    cols = ["seq", "taken_before", "made_before"]
    cols += ["prev_outcome", "rate_before"] if mode == "corrected" else []
    return {r.id: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("mode", ["corrected", "parity"])
@pytest.mark.parametrize("rows_per_task", [5_000_000, 40, 2])
def test_against_brute_force(spark, mode, rows_per_task):
    rows = random_rows()
    df = table(spark, SCHEMA, rows).repartition(5)
    got = tallies(df, mode, rows_per_task=rows_per_task)
    assert by_id(got, mode) == brute_force(rows, mode)


@pytest.mark.parametrize("mode", ["corrected", "parity"])
def test_more_large_games_than_can_be_listed(spark, monkeypatch, mode):
    monkeypatch.setattr("evkit.operators.blocks.MAX_LISTED_GROUPS", 1)
    rows = random_rows()
    got = tallies(table(spark, SCHEMA, rows), mode, rows_per_task=40)
    assert by_id(got, mode) == brute_force(rows, mode)


def test_only_large_games_are_cut_into_blocks(spark, monkeypatch):
    from evkit.operators import windows

    seen = []

    def watched(df, order, rows, per_block):
        seen.append((rows, {r.game for r in df.select("game").distinct().collect()}))
        return ordered_blocks(df, order, rows, per_block)

    monkeypatch.setattr(windows, "ordered_blocks", watched)
    rows = random_rows()
    got = tallies(table(spark, SCHEMA, rows), rows_per_task=80)
    assert by_id(got, "corrected") == brute_force(rows, "corrected")
    assert seen == [(sum(r[0] == 1 for r in rows), {1})]


def test_a_null_game_is_a_game(spark):
    rows = [(None, 1, 1, 5, 1, True), (None, 1, 1, 4, 2, False), (1, 1, 1, 5, 3, True)]
    df = table(spark, SCHEMA, rows)
    plain = by_id(tallies(df), "corrected")
    assert plain == by_id(tallies(df, rows_per_task=1), "corrected")
    assert plain[2] == (2, 1, 1, 1, 1.0)


def test_parity_quirks(spark):
    rows = [
        (1, 1, 1, 9, 1, False),  # first attempt: 0, 0
        (1, 2, 1, 8, 2, False),  # first of its player: 0, 0 although one was taken
        (1, 1, 1, 7, 3, False),  # nothing made so far: -1
        (1, 3, 1, 6, 4, True),   # two attempts on one clock: neither is reset
        (1, 3, 1, 6, 5, True),
    ]
    got = by_id(tallies(table(spark, SCHEMA, rows), "parity"), "parity")
    assert got == {1: (1, 0, 0), 2: (2, 0, 0), 3: (3, 2, -1), 4: (4, 3, 0), 5: (5, 4, 1)}


def test_partitioning_does_not_matter(spark):
    df = table(spark, SCHEMA, random_rows(200))
    assert rows_of(tallies(df.repartition(1))) == rows_of(tallies(df.repartition(7)))


def test_user_columns_with_underscores_stay(spark):
    df = table(spark, SCHEMA, random_rows(50)).withColumn("_note", F.lit("x"))
    for limit in (5_000_000, 10):
        assert "_note" in tallies(df, rows_per_task=limit).columns


def test_arguments(spark):
    df = table(spark, SCHEMA, [(1, 1, 1, 1, 1, True)])
    with pytest.raises(ValueError):
        running_tallies(df, "game", "player", ORDER, "made", [])
    with pytest.raises(ValueError):
        tallies(df, "other")


def test_blocks_follow_the_order(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 10)
    blocks = ordered_blocks(df, ["k", "-id"], 1000, 100)
    per_block = blocks.groupBy("_block").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in per_block) == 1000
    assert max(r.n for r in per_block) < 400
    ends = blocks.groupBy("_block").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    ends = ends.orderBy("_block").collect()
    assert all(a.hi <= b.lo for a, b in zip(ends, ends[1:]))
