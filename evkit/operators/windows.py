"""Running tallies inside ordered groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evkit.functions import as_col, flag_to_label, safe_ratio, sort_keys
from evkit.operators.blocks import (
    BLOCK,
    ROWS_PER_TASK,
    group_sizes,
    large_groups,
    ordered_blocks,
)

_HIT = "_hit"
_HELPERS = [
    _HIT, BLOCK, "_pos", "_seen", "_hits", "_own_pos", "_own_hits", "_own_prev",
    "_pos_before", "_seen_before", "_hits_before", "_own_before", "_own_hits_before",
    "_last_before", "_alone",
]


def running_tallies(
    df: DataFrame,
    game: str,
    entity: str,
    order: Sequence[str],
    made: str | Column,
    tiebreak: Sequence[str],
    mode: str = "corrected",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Tallies of attempts before the current one.

    `order` is the clock, `tiebreak` makes it total; a leading "-" sorts a column descending.

    mode="corrected" adds, per (game, entity): `taken_before`, `made_before`, `prev_outcome`
    (null on the first attempt) and `rate_before` (null on the first attempt).
    mode="parity" adds the same counts over the whole game, the current attempt included, minus
    one; both are 0 on the first attempt of an entity, unless a second one shares its clock.
    Both add `seq`, the position in the game.

    Games of up to `rows_per_task` rows take one shuffle by game. Larger ones go through
    `ordered_blocks`, on their own where they can be listed; the result is the same.
    """
    if mode not in ("corrected", "parity"):
        raise ValueError(f"unknown mode {mode!r}")
    if not tiebreak:
        raise ValueError("a tiebreak is needed: equal clocks would make the tallies random")
    df = df.withColumn(_HIT, flag_to_label(as_col(made)))
    total_order = [*order, *tiebreak]
    in_one_pass = _corrected if mode == "corrected" else _parity
    in_blocks = _corrected_in_blocks if mode == "corrected" else _parity_in_blocks

    def one_pass(part: DataFrame) -> DataFrame:
        return in_one_pass(part, game, entity, order, total_order).drop(_HIT)

    def blocks(part: DataFrame, rows: int) -> DataFrame:
        cut = ordered_blocks(part, [game, *total_order], rows, rows_per_task)
        return in_blocks(cut, game, entity, order, total_order)

    sizes = group_sizes(df, [game])
    if sizes.largest <= rows_per_task:
        return one_pass(df)
    large = large_groups(df, game, rows_per_task)
    if large is None:
        return blocks(df, sizes.rows)
    names = [r.key for r in large if r.key is not None]
    null_is_large = F.lit(len(names) < len(large))
    is_large = F.when(F.col(game).isNull(), null_is_large).otherwise(F.col(game).isin(names))
    return one_pass(df.filter(~is_large)).unionByName(
        blocks(df.filter(is_large), sum(r.n for r in large))
    )


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _so_far(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _with_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("rate_before", safe_ratio("made_before", "taken_before"))


def _corrected(df, game, entity, order, total_order):
    in_game = Window.partitionBy(game).orderBy(*sort_keys(total_order))
    own = Window.partitionBy(game, entity).orderBy(*sort_keys(total_order))
    return _with_rate(
        df.withColumns(
            {
                "seq": F.row_number().over(in_game).cast("long"),
                "taken_before": F.count(F.lit(1)).over(_before(own)),
                "made_before": F.coalesce(F.sum(_HIT).over(_before(own)), F.lit(0)),
                "prev_outcome": F.lag(_HIT).over(own),
            }
        )
    )


def _parity(df, game, entity, order, total_order):
    in_game = Window.partitionBy(game).orderBy(*sort_keys(total_order))
    by_clock = Window.partitionBy(game, entity).orderBy(*sort_keys(order))
    # The default frame takes in rows of equal clock: 1 means first and alone.
    alone = F.count(entity).over(by_clock) == 1
    return (
        df.withColumns(
            {
                "seq": F.row_number().over(in_game).cast("long"),
                "taken_before": F.count(entity).over(_so_far(in_game)) - 1,
                "made_before": F.sum(_HIT).over(_so_far(in_game)) - 1,
                "_alone": alone,
            }
        )
        .withColumns(
            {
                c: F.when(F.col("_alone"), F.lit(0)).otherwise(F.col(c))
                for c in ("taken_before", "made_before")
            }
        )
        .drop("_alone")
    )


def _tally_blocks(blocks, game, entity, order, total_order):
    """Rows with their place inside the block, and what earlier blocks of the game add to it.

    Totals are formed per (game, block) and per (game, entity, block) and summed along the blocks,
    so the running sums see at most one row per block. One join brings them back to the rows.
    """
    in_block = Window.partitionBy(game, BLOCK).orderBy(*sort_keys(total_order))
    own = Window.partitionBy(game, BLOCK, entity).orderBy(*sort_keys(total_order))
    local = blocks.withColumns(
        {
            "_pos": F.row_number().over(in_block).cast("long"),
            "_seen": F.count(entity).over(_so_far(in_block)),
            "_hits": F.sum(_HIT).over(_so_far(in_block)),
            "_own_pos": F.row_number().over(own).cast("long"),
            "_own_hits": F.coalesce(F.sum(_HIT).over(_before(own)), F.lit(0)),
            "_own_prev": F.lag(_HIT).over(own),
        }
    )
    clock = F.struct(*[F.col(o.lstrip("-")) for o in order])
    totals = local.groupBy(game, entity, BLOCK).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(_HIT).alias("_h"),
        F.max_by(_HIT, "_own_pos").alias("_last"),
        F.min_by(clock, "_own_pos").alias("_first_clock"),
        F.max(F.when(F.col("_own_pos") == 2, clock)).alias("_second_clock"),
    )
    by_block = Window.partitionBy(game, entity).orderBy(BLOCK)
    second_clock = F.coalesce("_second_clock", F.lead("_first_clock").over(by_block))
    own_prior = totals.select(
        game,
        entity,
        BLOCK,
        _sum_before("_n", by_block).alias("_own_before"),
        _sum_before("_h", by_block).alias("_own_hits_before"),
        F.lag("_last").over(by_block).alias("_last_before"),
        (second_clock.isNull() | ~F.col("_first_clock").eqNullSafe(second_clock)).alias("_alone"),
    )
    along = Window.partitionBy(game).orderBy(BLOCK)
    game_prior = (
        blocks.groupBy(game, BLOCK)
        .agg(
            F.count(F.lit(1)).alias("_n"), F.count(entity).alias("_e"), F.sum(_HIT).alias("_h")
        )
        .select(
            game,
            BLOCK,
            _sum_before("_n", along).alias("_pos_before"),
            _sum_before("_e", along).alias("_seen_before"),
            _sum_before("_h", along).alias("_hits_before"),
        )
    )
    prior = _join_on(own_prior, game_prior, [game, BLOCK])
    joined = _join_on(local, prior, [game, entity, BLOCK])
    return joined.withColumn("seq", F.col("_pos") + F.col("_pos_before"))


def _sum_before(col: str, window) -> Column:
    return F.coalesce(F.sum(col).over(_before(window)), F.lit(0))


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null, which counts as a value of its own."""
    names = {k: f"_r{i}" for i, k in enumerate(keys)}
    side = right.withColumnsRenamed(names)
    condition = [F.col(k).eqNullSafe(F.col(r)) for k, r in names.items()]
    return left.join(side, condition, "left").drop(*names.values())


def _corrected_in_blocks(blocks, game, entity, order, total_order):
    tallied = _tally_blocks(blocks, game, entity, order, total_order).withColumns(
        {
            "taken_before": F.col("_own_pos") - 1 + F.col("_own_before"),
            "made_before": F.col("_own_hits") + F.col("_own_hits_before"),
            "prev_outcome": F.when(F.col("_own_pos") == 1, F.col("_last_before")).otherwise(
                F.col("_own_prev")
            ),
        }
    )
    return _with_rate(tallied).drop(*_HELPERS)


def _parity_in_blocks(blocks, game, entity, order, total_order):
    first_alone = (
        (F.col("_own_pos") + F.col("_own_before") == 1)
        & F.col("_alone")
        & F.col(entity).isNotNull()
    )
    tallied = _tally_blocks(blocks, game, entity, order, total_order).withColumns(
        {
            "taken_before": F.when(first_alone, F.lit(0)).otherwise(
                F.col("_seen") + F.col("_seen_before") - 1
            ),
            "made_before": F.when(first_alone, F.lit(0)).otherwise(
                F.col("_hits") + F.col("_hits_before") - 1
            ),
        }
    )
    return tallied.drop(*_HELPERS)
