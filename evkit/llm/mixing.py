"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 4, DataFrame only).

Each document draws u in (0, 1) from a hash of its id and has the exponential key -ln(u) / quality.
Sorted by key within a source, sizes are summed up to the source's budget of tokens. A target beyond the
source's size takes whole epochs first and selects only the rest.

Nothing sorts a whole source. A histogram of the keys (SLOTS slots a source) gives the slot in which the
budget runs out; only its rows are ranked, and the key at the cut is one row per source. A document's
share then follows from its own key, so texts never shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evkit.llm.common import whole_row, with_new, word_count
from evkit.session import write_once

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
SLOTS = 16384
SEED = 20240501


def plain_share(text: Column) -> Column:
    """Quality weight from 0.05 to 1: the square of the share of characters that are no symbols.

    Empty texts and nulls weigh 1.
    """
    full = F.coalesce(text, F.lit(""))
    plain = F.length(F.translate(full, r"!#$%&*+/<=>@\^_`{|}~", ""))
    share = F.when(F.length(full) == 0, 1.0).otherwise(plain / F.length(full))
    return F.greatest(F.lit(0.05), share * share)


def uniform(*cols: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) from a hash of the columns; the same on every run."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) + 0.5) / float(1 << 53)


def source_targets(
    totals: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
) -> DataFrame:
    """`totals` (origin, total), one row per source, plus `target`.

    Sources by code point, null last, take the weights in turn, and share `share` of all sizes by weight.
    No target exceeds `max_epochs` times its source's size; the excess goes to the others by weight until
    none is above. Sources in the order in which they fill up: the first that need not be cut fixes the
    level (target over weight) of all after it. Running sums give it without a loop. The windows see one
    row per source, never documents.
    """
    every = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("origin").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights) + 1)
    ranked = totals.withColumns({"weight": weight, "cap": F.col("total") * F.lit(float(max_epochs))})
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("origin").asc_nulls_last())
    full = F.coalesce(
        F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    )
    open_weight = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("total").over(every) * F.lit(float(share)) - full) / open_weight
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn(
        "level",
        F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every),
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return ranked.select("origin", "total", target.alias("target"))


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    quality: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """All rows and columns of `docs` plus `size`, `source_size`, `target`, `taken`, `copies`.

    `copies` is how often the mix takes the document (0, 1 or 2 by default), `taken` its words times
    that. Within a source, whole documents are taken in the order of their keys as long as they bring the
    source nearer to its target, so a source misses its target by half a document at most. Reruns agree.
    `quality` scales the keys: a document of twice the quality is twice as likely to come first.

    Null and empty texts have size 0; a null source is a source of its own. Rows with equal id and text
    draw the same key and are taken together. Columns of `docs` with the new names are replaced. An empty
    table gives an empty table.
    """
    return with_new(
        _decided(docs, text, source, doc_id, quality, weights, share, max_epochs, seed),
        ["size", "source_size", "target", "taken", "copies"],
    )


def mixed_rows(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id",
               **settings: object) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with the columns of `docs`."""
    settings = {"quality": None, "weights": WEIGHTS, "share": SHARE, "max_epochs": MAX_EPOCHS,
                "seed": SEED, **settings}
    decided = _decided(docs, text, source, doc_id, **settings)
    times = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("time")
    return with_new(decided.filter("copies > 0").select("row", times), [])


def _decided(docs, text, source, doc_id, quality, weights, share, max_epochs, seed) -> DataFrame:
    """row, size, source_size, target, taken, copies."""
    weigh = quality if quality is not None else plain_share(F.col(text))
    keyed = docs.select(
        whole_row(docs),
        F.col(source).alias("origin"),
        word_count(F.col(text)).alias("size"),
        (-F.log(uniform(F.col(doc_id), seed=seed)) / weigh).alias("key"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("tie"),
    )
    # Keys of one rate spread evenly over the slots; other rates make some slots a little fuller.
    keyed = keyed.withColumn("slot", F.floor((1.0 - F.exp(-F.col("key"))) * SLOTS).cast("int"))
    keys = write_once(keyed.drop("row"), "mix-keys")

    slots = keys.groupBy("origin", "slot").agg(F.sum("size").alias("in_slot"))
    totals = slots.groupBy("origin").agg(F.sum("in_slot").alias("total"))
    epochs = F.when(F.col("total") > 0, F.floor(F.col("target") / F.nullif(F.col("total"), F.lit(0))))
    targets = source_targets(totals, weights, share, max_epochs)
    targets = targets.withColumn("epochs", F.coalesce(epochs, F.lit(0)).cast("int"))
    targets = write_once(
        targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("total")), "mix-targets"
    )
    cut_slots = (
        _with_source(slots, targets, ["budget"])
        .withColumn("upto", F.sum("in_slot").over(Window.partitionBy("origin").orderBy("slot")))
        .withColumn("before", F.col("upto") - F.col("in_slot"))
        .filter("before < budget AND budget <= upto")
        .select("origin", F.col("slot").alias("cut"), "before", "budget")
    )
    cut_slots = write_once(cut_slots, "mix-slots")
    # Rows with equal (key, tie) are one step.
    steps = (
        _with_source(keys, cut_slots, ["cut", "before", "budget"])
        .filter("slot = cut")
        .groupBy("origin", "key", "tie")
        .agg(F.sum("size").alias("step"), F.max("before").alias("before"),
             F.max("budget").alias("budget"))
    )
    upto = F.col("before") + F.sum("step").over(Window.partitionBy("origin").orderBy("key", "tie"))
    nearer = F.abs(F.col("upto") - F.col("budget")) <= F.abs(
        F.col("upto") - F.col("step") - F.col("budget")
    )
    last = (
        steps.withColumn("upto", upto)
        .filter(nearer)
        .groupBy("origin")
        .agg(F.max(F.struct("key", "tie")).alias("last"))
    )
    # Where no document of the slot is taken, the cut is the slot's lower edge.
    plan = _with_source(targets, cut_slots, ["cut"])
    plan = write_once(_with_source(plan, write_once(last, "mix-last"), ["last"]), "mix-plan")

    out = _with_source(keyed, plan, ["total", "target", "epochs", "cut", "last"])
    in_cut = (F.col("slot") == F.col("cut")) & (F.struct("key", "tie") <= F.col("last"))
    more = (F.col("size") > 0) & ((F.col("slot") < F.col("cut")) | in_cut)
    copies = F.col("epochs") + F.coalesce(more, F.lit(False)).cast("int")
    return out.select(
        "row",
        "size",
        F.col("total").cast("long").alias("source_size"),
        "target",
        (F.col("size") * copies).cast("long").alias("taken"),
        copies.alias("copies"),
    )


def _with_source(df: DataFrame, plan: DataFrame, cols: list[str]) -> DataFrame:
    """Left join by source with one written row per source.

    The size of its files tells Spark before the run whether to broadcast it; beyond the threshold it
    sorts and splits the partitions of hot sources.
    """
    table = plan.select(F.col("origin").alias("of"), *cols)
    return df.join(table, F.col("origin").eqNullSafe(F.col("of")), "left").drop("of")
