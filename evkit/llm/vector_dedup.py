"""Near-duplicate vectors by an inverted multi-index (operator 8).

Two codebooks, one per half of the unit vectors, span a grid of cells. Every vector is indexed in the cell of its
nearest pair of centroids. A query visits cells in the order of their distance (the sum of both halves'
distances), as many as reach the target recall; what it meets there is verified by its cosine in double
precision. The number of visited cells is set on the sample the codebooks are fitted on: neighbours right at
the limit are drawn around sampled vectors, and the visits that reach `recall` of their cells are kept.
A pair counts for both vectors, even if only one of them visits the other's cell.

The grid grows with the table: about PER_CELL entries a cell, up to MOST_CENTROIDS ** 2 cells. The sample has
SAMPLE vectors, or SAMPLE_EACH per centroid if that is more. Vectors of different lengths have no cosine, so each
length has an index of its own.

Equal vectors are one entry. Cells are cut into blocks of about BLOCK entries, so a hot cell is many tasks; a task
returns counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evkit.llm.common import whole_row, with_new
from evkit.llm.components import components
from evkit.session import write_once

LIMIT = 0.95
RECALL = 0.98
CENTROIDS = 32
MOST_CENTROIDS = 1024
PER_CELL = 64
SAMPLE = 4096
SAMPLE_EACH = 32
BLOCK = 1024
SLICE = 256


def _far(rows: np.ndarray, books: list[np.ndarray]) -> list[np.ndarray]:
    """For each half, (rows, centroids): squared distances."""
    half = rows.shape[1] // 2
    parts = rows[:, :half], rows[:, half:]
    return [(p**2).sum(1)[:, None] - 2 * p @ b.T + (b**2).sum(1)[None, :] for p, b in zip(parts, books)]


def nearest_cells(rows: np.ndarray, books: list[np.ndarray], visits: int) -> np.ndarray:
    """(rows, visits): the nearest cells in order, by multi-sequence traversal of the halves' sorted distances.

    The pair of the i-th and j-th nearest centroids comes after the i * j - 1 pairs of nearer ones, so only pairs
    with i * j <= visits can be visited. Of equal distances the lower ranks come first.
    """
    first, second = _far(rows, books)
    by_first, by_second = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
    i, j = np.meshgrid(np.arange(min(visits, first.shape[1])), np.arange(min(visits, second.shape[1])), indexing="ij")
    due = (i + 1) * (j + 1) <= visits
    i, j = i[due], j[due]
    left, right = by_first[:, i], by_second[:, j]
    far = np.take_along_axis(first, left, 1) + np.take_along_axis(second, right, 1)
    order = np.argsort(far, axis=1, kind="stable")[:, :visits]
    return np.take_along_axis(left, order, 1) * len(books[1]) + np.take_along_axis(right, order, 1)


def _codebook(rows: np.ndarray, rng: np.random.Generator, size: int) -> np.ndarray:
    centres = rows[rng.choice(len(rows), size=min(size, len(rows)), replace=False)]
    for _ in range(12):
        nearest = np.argmax(rows @ centres.T - (centres**2).sum(1) / 2, axis=1)
        for c in np.unique(nearest):
            centres[c] = rows[nearest == c].mean(0)
    return centres


def fit_index(sample: np.ndarray, limit: float = LIMIT, recall: float = RECALL, size: int = CENTROIDS):
    """Codebooks and the number of cells that a query visits."""
    rng = np.random.default_rng(7)
    half = sample.shape[1] // 2
    books = [_codebook(sample[:, :half], rng, size), _codebook(sample[:, half:], rng, size)]
    some = sample[:1024]
    noise = rng.normal(size=some.shape)
    noise -= (noise * some).sum(1, keepdims=True) * some
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    near = limit * some + np.sqrt(1 - limit**2) * noise
    cells = nearest_cells(near, books, 1)[:, 0]
    rank = []
    for low in range(0, len(some), 16):
        first, second = _far(some[low : low + 16], books)
        asked = (first[:, :, None] + second[:, None, :]).reshape(len(first), -1)
        own = asked[np.arange(len(asked)), cells[low : low + 16]]
        rank.append((asked < own[:, None]).sum(1))
    return books, int(np.quantile(np.concatenate(rank), recall, method="higher")) + 1


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest place connected with each of n places by links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def units(column) -> np.ndarray:
    found = np.array(list(column), dtype="float64")
    found /= np.abs(found).max(1, keepdims=True)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _links(entries: DataFrame, limit: float, recall: float) -> DataFrame:
    """(a, b, n) for `entries` (entry, copies, values) of one length: a spanning forest of the links found (n = 0),
    and for each linked entry, as (a, a), how many vectors it links with."""
    n = entries.count()
    size = int(min(MOST_CENTROIDS, max(CENTROIDS, np.ceil(np.sqrt(n / PER_CELL)))))
    # At most `wanted` vectors reach the driver, for the codebooks alone.
    wanted = max(SAMPLE, SAMPLE_EACH * size)
    picked = entries.orderBy(F.xxhash64("entry"), "entry").limit(wanted).select("values").collect()
    books, visits = fit_index(units([r["values"] for r in picked]), limit, recall, size)

    @F.pandas_udf("array<int>")
    def visited(column: pd.Series) -> pd.Series:
        out = []
        for low in range(0, len(column), SLICE):
            out.extend(nearest_cells(units(column.iloc[low : low + SLICE]), books, visits).astype("int32"))
        return pd.Series(out)

    placed = write_once(entries.withColumn("cells", visited("values")), "cells")
    home = placed.withColumn("cell", F.col("cells")[0])
    sizes = home.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    # One row per cell of the grid, so its size is known once it is written.
    sizes = write_once(sizes, "cell-sizes")
    stored = home.join(sizes, "cell").select(
        "cell", F.pmod(F.xxhash64("entry"), "blocks").alias("block"), "entry", "copies", "values", "cells")
    asked = placed.select("entry", "copies", "values", F.col("cells")[0].alias("home"), F.explode("cells").alias("cell"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    asked = asked.join(sizes, "cell").select("cell", "entry", "copies", "values", "home", each)
    # Queries of a block come in parts of about BLOCK, too; each part meets the whole block.
    parts = asked.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).alias("parts"))
    asked = asked.join(parts, ["cell", "block"]).withColumn("part", F.pmod(F.xxhash64("entry", F.lit(1)), "parts"))
    stored = stored.join(parts, ["cell", "block"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

    def compare(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(members):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        held, ids = units(members["values"]), members["entry"].to_numpy()
        asking, copies = queries["entry"].to_numpy(), members["copies"].to_numpy()
        names, place = np.unique(np.concatenate([asking, ids]), return_inverse=True)
        left, right = place[: len(asking)], place[len(asking) :]
        counts, label = np.zeros(len(asking), dtype="int64"), np.arange(len(names))
        vectors = units(queries["values"])
        # Members that visit a query's home cell find that pair there as well; the others are told here.
        cells = np.array(list(members["cells"]))
        home, times, told = queries["home"].to_numpy(), queries["copies"].to_numpy(), np.zeros(len(ids), dtype="int64")
        for low in range(0, len(asking), SLICE):
            near = vectors[low : low + SLICE] @ held.T >= limit
            near &= asking[low : low + SLICE, None] != ids[None, :]
            counts[low : low + SLICE] = near @ copies
            q, m = np.nonzero(near)
            unseen = ~(cells[m] == home[low + q][:, None]).any(1)
            np.add.at(told, m[unseen], times[low + q[unseen]])
            a, b = np.concatenate([left[low + q], np.arange(len(names))]), np.concatenate([right[m], label])
            label = _forest(a, b, len(names))
        both, n = np.concatenate([asking, ids]), np.concatenate([counts, told])
        links = pd.DataFrame({"a": both, "b": both, "n": n})[n > 0]
        joined = label != np.arange(len(names))
        tree = pd.DataFrame({"a": names[joined], "b": names[label[joined]], "n": 0})
        return pd.concat([links, tree]).astype("int64")

    # Both sides come from one table; as a table of its own, one has columns of its own.
    stored = write_once(stored.drop("parts"), "blocks")
    keys = ["cell", "block", "part"]
    met = asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInPandas(compare, "a long, b long, n long")
    return write_once(met, "vector-links")


def link_vectors(docs: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", limit: float = LIMIT,
                 recall: float = RECALL) -> DataFrame:
    """All rows and columns of `docs` plus `n_links`, `component_id`, `kept`.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; nor do rows
    without an id, which no link could name. Vectors of different lengths do not link. Ids are unique. Columns with
    the new names are replaced. An empty table gives an empty table.
    """
    values = F.col(vector).cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    biggest = F.array_max(F.transform(values, F.abs))
    rows = docs.select(whole_row(docs), F.col(vec_id).alias("id"),
                       F.when(fine & (biggest > 0) & F.col(vec_id).isNotNull(), values).alias("values"))
    rows = rows.withColumn("code", F.sha2(F.array_join("values", ",").cast("binary"), 256))
    entries = rows.filter("values IS NOT NULL").groupBy("code").agg(
        F.min("id").alias("entry"), F.count(F.lit(1)).alias("copies"), F.first("values").alias("values"))
    entries = write_once(entries, "vectors")
    # Lengths are few: as a rule one.
    widths = sorted(r["n"] for r in entries.select(F.size("values").alias("n")).distinct().collect())
    met = docs.sparkSession.createDataFrame([], "a long, b long, n long")
    for width in widths:
        met = met.unionByName(_links(entries.filter(F.size("values") == width), limit, recall))
    labels = components(met.select("a", "b"))
    counts = met.groupBy(F.col("a").alias("entry")).agg(F.sum("n").alias("n"))
    known = entries.select("code", "entry", "copies").join(counts, "entry", "left").join(
        labels.withColumnRenamed("id", "entry"), "entry", "left")
    known = known.select(F.col("code").alias("of"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                         F.coalesce("label", "entry").alias("component"))
    out = rows.join(known, F.col("code") == F.col("of"), "left").withColumns({
        "n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component_id": F.coalesce("component", "id")})
    out = out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("id")))
    return with_new(out, ["n_links", "component_id", "kept"])
