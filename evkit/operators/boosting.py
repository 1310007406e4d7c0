"""Boosted trees on histograms (L9): at most `max_leaves` leaves a tree, grown best first, with an L2 term.

Features become bins, and rows with equal bins one weighted cell, which changes no sum of a fit. A pass over the cells
adds up gradients and Hessians per (leaf, feature, bin): each task makes its histograms, Spark adds them up in a tree
of tasks, and only they reach the driver, at most max_leaves x features x MAX_BINS numbers however many the rows. The
driver picks the splits. All leaves that the best-first order may still reach are counted in one pass, so a tree takes
as many passes as it is deep.

The passes are hundreds of small steps over the same arrays, so the cells are kept as an RDD of array blocks, and its
lineage is cut by checkpoints.

Boosting goes on while the loss on watched rows falls: it stops when none of the last `patience` rounds was better
than the one before them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evkit.functions import as_col
from evkit.operators.categories import dictionary, encode_categories
from evkit.session import ensure_checkpoints, write_once

# Fixed values of the model.
BOOSTING_ROUNDS = 300
LEARNING_RATE = 0.06
MAX_LEAVES = 31
MIN_LEAF_ROWS = 100
L2 = 1.0
PATIENCE = 10
STOP_TOLERANCE = 1e-7

# Bins of values; bin 0 is for missing numbers.
MAX_BINS = 255
MIN_HESSIAN = 1e-3
# Rounds after which the cells get new margins and a checkpoint.
REWRITE = 16
# Cells that one task adds up in a pass.
CELLS_PER_TASK = 200_000
BLOCK = "bins binary, watched binary, n binary, pos binary"


class Node(NamedTuple):
    """A split (rows with bin <= `bin` go left) or, with feature -1, a leaf."""

    feature: int
    bin: int
    left: int
    right: int
    value: float


class Boosted(NamedTuple):
    """A fitted model. `codes` is the category table, `edges` the upper limits of the bins per feature."""

    cats: tuple[str, ...]
    nums: tuple[str, ...]
    codes: DataFrame | None
    edges: list[list[float]]
    start: float
    trees: list[list[Node]]
    losses: list[float]


def _leaf_of(tree: list[Node], bins: np.ndarray) -> np.ndarray:
    """The leaf (its place in the tree) of each row of bins."""
    feature, limit, left, right = (np.array([n[k] for n in tree]) for k in range(4))
    at = np.zeros(len(bins), dtype="int64")
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return at
        node = at[inner]
        goes_left = bins[inner, feature[node]] <= limit[node]
        at[inner] = np.where(goes_left, left[node], right[node])


def _margins(trees: Sequence[list[Node]], bins: np.ndarray, start: np.ndarray | float) -> np.ndarray:
    out = np.zeros(len(bins)) + start
    for tree in trees:
        out += np.array([n.value for n in tree])[_leaf_of(tree, bins)]
    return out


def _bins_of(column: pd.Series, width: int) -> np.ndarray:
    return np.array(list(column), dtype="int64").reshape(len(column), width)


def _features(df: DataFrame, cats: Sequence[str], nums: Sequence[str], codes: DataFrame | None) -> DataFrame:
    """`df` plus _f0, _f1, ... as doubles; missing numbers are null, unseen categories -1."""
    names = {c: f"_f{i}" for i, c in enumerate(cats)}
    coded = encode_categories(df, codes, names) if cats else df
    places = {f"_f{len(cats) + i}": F.col(c).cast("double") for i, c in enumerate(nums)}
    return coded.withColumns({k: F.when(~F.isnan(v), v) for k, v in places.items()}) if places else coded


def _edges(coded: DataFrame, width: int) -> list[list[float]]:
    """Per feature, the limits between its bins: between neighbouring values if they are few, else quantiles."""
    cells = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"_f{i}").alias("v")) for i in range(width)])
    values = coded.select(F.explode(cells).alias("cell")).select("cell.*").filter(F.col("v").isNotNull())
    distinct = write_once(values.distinct(), "feature-values")
    sizes = {r["f"]: r["n"] for r in distinct.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = [f for f, n in sizes.items() if n <= MAX_BINS]
    out: list[list[float]] = [[] for _ in range(width)]
    # At most MAX_BINS values per feature.
    listed: dict[int, list[float]] = {f: [] for f in few}
    for row in distinct.filter(F.col("f").isin(few)).collect() if few else []:
        listed[row["f"]].append(row["v"])
    for f, found in listed.items():
        found.sort()
        out[f] = [(a + b) / 2 for a, b in zip(found, found[1:])]
    many = [f for f, n in sizes.items() if n > MAX_BINS]
    if many:
        shares = [i / MAX_BINS for i in range(1, MAX_BINS)]
        row = coded.agg(*[F.percentile_approx(f"_f{f}", shares, 100 * MAX_BINS).alias(f"q{f}") for f in many]).first()
        for f in many:
            out[f] = sorted(set(row[f"q{f}"]))
    return out


def _binned(coded: DataFrame, edges: list[list[float]]) -> DataFrame:
    """`coded` plus `_bins`: 0 for a missing number, else 1 + the number of limits that the value reaches."""
    cut = [i for i, e in enumerate(edges) if e]
    infinite = float("inf")
    if cut:
        # Missing numbers get a bin of their own below; -inf only keeps the bucketizer from failing on them.
        filled = coded.withColumns({f"_g{i}": F.coalesce(f"_f{i}", F.lit(-infinite)) for i in cut})
        coded = Bucketizer(
            splitsArray=[[-infinite, *edges[i], infinite] for i in cut],
            inputCols=[f"_g{i}" for i in cut], outputCols=[f"_b{i}" for i in cut],
        ).transform(filled).drop(*[f"_g{i}" for i in cut])
    bins = [F.when(F.col(f"_f{i}").isNull(), 0).otherwise(F.col(f"_b{i}").cast("int") + 1 if e else F.lit(1))
            for i, e in enumerate(edges)]
    return coded.withColumn("_bins", F.array(*bins).cast("array<int>")).drop(*[f"_b{i}" for i in cut])


class _Block(NamedTuple):
    """Some cells as arrays: bins (cells, features), and per cell the rows, the positive ones, and the margin."""

    bins: np.ndarray
    watched: np.ndarray
    n: np.ndarray
    pos: np.ndarray
    margin: np.ndarray


def _blocks(cells: DataFrame, width: int, tasks: int, start: float) -> RDD:
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kinds = {"watched": "bool", "n": "float64", "pos": "float64"}
            row = {c: frame[c].to_numpy(kind).tobytes() for c, kind in kinds.items()}
            yield pd.DataFrame([{"bins": _bins_of(frame["bins"], width).astype("int16").tobytes(), **row}])

    def unpack(row) -> _Block:
        n = np.frombuffer(row["n"], "float64")
        bins = np.frombuffer(row["bins"], "int16").reshape(len(n), width)
        return _Block(bins, np.frombuffer(row["watched"], "bool"), n, np.frombuffer(row["pos"], "float64"), np.full(len(n), start))

    return cells.repartition(tasks).mapInPandas(pack, BLOCK).rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)


def _advanced(blocks: RDD, trees: list[list[Node]]) -> RDD:
    """The blocks with the trees in their margins, from a checkpoint on."""
    new = blocks.map(lambda b: b._replace(margin=_margins(trees, b.bins, b.margin))).persist(StorageLevel.MEMORY_AND_DISK)
    new.checkpoint()
    new.count()
    blocks.unpersist()
    return new


def _histograms(blocks: RDD, width: int, trees: list[list[Node]], tree: list[Node], wanted: dict[int, int],
                watch: bool) -> tuple[np.ndarray, np.ndarray]:
    """((gradients, Hessians, rows) per place in `wanted`, feature and bin, (loss, rows) of the watched rows).

    `trees` are those whose values the margins lack, `wanted` the leaves of `tree` to count.
    """
    size = MAX_BINS + 1
    place = np.full(len(tree), -1)
    for node, k in wanted.items():
        place[node] = k

    def count(block: _Block) -> tuple[np.ndarray, np.ndarray]:
        held, loss = np.zeros((3, len(wanted), width, size)), np.zeros(2)
        bins, watched, n, pos, _ = block
        margin = _margins(trees, bins, block.margin)
        if watch and watched.any():
            m = margin[watched]
            each = np.log1p(np.exp(-np.abs(m))) + np.maximum(m, 0)
            loss += n[watched] @ each - pos[watched] @ m, n[watched].sum()
        where = place[_leaf_of(tree, bins)]
        used = np.flatnonzero(~watched & (where >= 0))
        chance = 1 / (1 + np.exp(-margin[used]))
        weights = n[used] * chance - pos[used], n[used] * chance * (1 - chance), n[used]
        for f in range(width):
            slot = where[used] * size + bins[used, f]
            for k, w in enumerate(weights):
                held[k, :, f] = np.bincount(slot, w, len(wanted) * size).reshape(len(wanted), size)
        return held, loss

    return blocks.map(count).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))


class _Grown(NamedTuple):
    """A node while its tree grows: sums over its rows, and its best split if it is known and there is one."""

    g: float
    h: float
    n: float
    split: tuple | None


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, min_rows: float, l2: float):
    """(gain, feature, bin, left sums, right sums) of the best split of one node's (features, bins) sums, or None.

    Equal gains, to nine digits, go to the first feature and then the lowest bin.
    """
    gl, hl, nl = np.cumsum(g, 1), np.cumsum(h, 1), np.cumsum(n, 1)
    total = gl[0, -1], hl[0, -1], nl[0, -1]
    gr, hr, nr = total[0] - gl, total[1] - hl, total[2] - nl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - total[0] ** 2 / (total[1] + l2)
    allowed = (nl >= min_rows) & (nr >= min_rows) & (hl >= MIN_HESSIAN) & (hr >= MIN_HESSIAN)
    # A limit that no row lies between is no split of its own.
    allowed &= n > 0
    gain = np.where(allowed, gain, 0.0)
    top = float(gain.max())
    if top <= 1e-12:
        return None
    f, b = np.unravel_index(int(np.argmax(gain >= top * (1 - 1e-9))), gain.shape)
    return (top, int(f), int(b), (gl[f, b], hl[f, b], nl[f, b]), (gr[f, b], hr[f, b], nr[f, b]))


def _grow(count, max_leaves: int, min_rows: float, l2: float, rate: float, first: np.ndarray) -> list[Node]:
    """One tree. `count(tree, wanted)` gives the histograms of leaves; `first` has those of the root."""

    def node_of(sums, found: np.ndarray, k: int) -> _Grown:
        return _Grown(*sums, best_split(*found[:, k], min_rows, l2))

    root = first[:, 0, 0].sum(1)
    known = {0: node_of(root, first, 0)}
    children: dict[int, tuple[int, int]] = {}
    while True:
        # Best first over what is known; leaves whose histograms are not known yet wait.
        heap = [(-known[0].split[0], 0)] if known[0].split else []
        leaves, chosen, unknown = 1, [], []
        while heap and leaves < max_leaves:
            _, node = heapq.heappop(heap)
            chosen.append(node)
            leaves += 1
            if node not in children:
                children[node] = len(known), len(known) + 1
                for child, sums in zip(children[node], known[node].split[3:]):
                    known[child] = _Grown(*sums, None)
                    # A leaf of fewer rows than two leaves need cannot be split.
                    if sums[2] >= 2 * min_rows:
                        unknown.append(child)
            for child in children[node]:
                if known[child].split:
                    heapq.heappush(heap, (-known[child].split[0], child))
        if not unknown:
            break
        tree = [Node(*known[i].split[1:3], *children[i], 0.0) if i in children else Node(-1, 0, 0, 0, 0.0)
                for i in range(len(known))]
        wanted = {node: k for k, node in enumerate(unknown)}
        found = count(tree, wanted)
        for node, k in wanted.items():
            known[node] = node_of(known[node][:3], found, k)
    places = {0: 0}
    for node in sorted(chosen):
        for child in children[node]:
            places[child] = len(places)
    return [
        Node(*known[node].split[1:3], *(places[c] for c in children[node]), 0.0) if node in chosen
        else Node(-1, 0, 0, 0, -rate * known[node].g / (known[node].h + l2))
        for node in sorted(places, key=places.get)
    ]


def _stalled(losses: list[float], patience: int, tolerance: float) -> bool:
    """None of the last `patience` losses is better than the one before them."""
    if len(losses) <= patience:
        return False
    return not any(x < losses[-patience - 1] - tolerance for x in losses[-patience:])


def fit_boosted(
    train: DataFrame,
    cats: Sequence[str],
    nums: Sequence[str],
    label: str,
    watched: str | Column | None = None,
    rounds: int = BOOSTING_ROUNDS,
    rate: float = LEARNING_RATE,
    max_leaves: int = MAX_LEAVES,
    min_rows: int = MIN_LEAF_ROWS,
    l2: float = L2,
    patience: int = PATIENCE,
    tolerance: float = STOP_TOLERANCE,
) -> Boosted:
    """Boosted trees for a 0/1 label.

    Categories are ordered alphabetically and coded by their place, like numbers; unseen ones and nulls come before
    all others. Null numbers come before all numbers. Rows without a label are left out. `watched` marks the rows
    that decide when to stop and are not learnt from; without it, all rounds are made.
    """
    cats, nums = tuple(cats), tuple(nums)
    width = len(cats) + len(nums)
    if not width:
        raise ValueError("a feature is needed")
    mark = F.lit(False) if watched is None else F.coalesce(as_col(watched), F.lit(False))
    rows = train.filter(F.col(label).isNotNull()).select(
        *dict.fromkeys([*cats, *nums]), F.col(label).cast("double").alias("_label"), mark.alias("_watched"))
    rows = write_once(rows, "boosting-rows")
    codes = dictionary(rows.filter("NOT _watched"), cats) if cats else None
    coded = _features(rows, cats, nums, codes)
    edges = _edges(coded.filter("NOT _watched"), width)
    cells = _binned(coded, edges).groupBy(F.col("_bins").alias("bins"), F.col("_watched").alias("watched")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("_label").alias("pos"))
    cells = write_once(cells, "design-cells")
    total = cells.agg(F.count(F.lit(1)).alias("cells"), *[
        F.sum(F.when(~F.col("watched"), F.col(c))).alias(c) for c in ("n", "pos")]).first()
    if not total["n"]:
        raise ValueError("no labelled rows to learn from")
    tasks = -(-total["cells"] // CELLS_PER_TASK)
    share = min(max(total["pos"] / total["n"], 1e-12), 1 - 1e-12)
    start = float(np.log(share / (1 - share)))
    ensure_checkpoints(train.sparkSession)
    blocks = _blocks(cells, width, tasks, start)
    stump = [Node(-1, 0, 0, 0, 0.0)]
    trees: list[list[Node]] = []
    losses: list[float] = []
    written = 0
    for _ in range(rounds):
        recent = trees[written:]
        first, (loss, seen) = _histograms(blocks, width, recent, stump, {0: 0}, watch=watched is not None)
        if seen:
            losses.append(float(loss / seen))
            if _stalled(losses, patience, tolerance):
                break
        grown = _grow(lambda tree, wanted: _histograms(blocks, width, recent, tree, wanted, False)[0],
                      max_leaves, min_rows, l2, rate, first)
        if len(grown) == 1:
            # Nothing is left to split on, and so it will stay.
            break
        trees.append(grown)
        if len(trees) - written >= REWRITE:
            blocks, written = _advanced(blocks, trees[written:]), len(trees)
    blocks.unpersist()
    return Boosted(cats, nums, codes, edges, start, trees, losses)


def score_boosted(model: Boosted, df: DataFrame, prob: str = "prob") -> DataFrame:
    """Input columns plus `prediction` (1 above a half) and the success probability."""
    binned = _binned(_features(df, model.cats, model.nums, model.codes), model.edges)
    trees, start, width = model.trees, model.start, len(model.edges)

    @F.pandas_udf("double")
    def chance(column: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-_margins(trees, _bins_of(column, width), start))))

    scored = binned.withColumn(prob, chance("_bins"))
    return scored.withColumn("prediction", (F.col(prob) > 0.5).cast("double")).select(*df.columns, "prediction", prob)


def save_boosted(model: Boosted, path: str) -> None:
    """Write the model as three small tables below `path`; `load_boosted` reads them in any session."""
    spark = SparkSession.getActiveSession()
    nodes = [(t, i, *map(int, node[:4]), float(node.value)) for t, tree in enumerate(model.trees) for i, node in enumerate(tree)]
    schema = "tree int, node int, feature int, bin int, left int, right int, value double"
    spark.createDataFrame(nodes, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    about = [(list(model.cats), list(model.nums), [[float(x) for x in e] for e in model.edges], model.start, model.losses)]
    schema = "cats array<string>, nums array<string>, edges array<array<double>>, start double, losses array<double>"
    spark.createDataFrame(about, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    if model.codes is not None:
        model.codes.write.mode("overwrite").parquet(f"{path}/codes")


def load_boosted(spark: SparkSession, path: str) -> Boosted:
    about = spark.read.parquet(f"{path}/about").first()
    trees: list[list[Node]] = []
    for row in spark.read.parquet(f"{path}/trees").orderBy("tree", "node").collect():
        if row["tree"] == len(trees):
            trees.append([])
        trees[-1].append(Node(*row[2:]))
    codes = spark.read.parquet(f"{path}/codes") if about["cats"] else None
    return Boosted(tuple(about["cats"]), tuple(about["nums"]), codes, [list(e) for e in about["edges"]], about["start"],
                   trees, list(about["losses"]))
