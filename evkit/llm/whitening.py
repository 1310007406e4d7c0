"""Embedding whitening by FEAST contour integration (operator 13).

Spark sums the vectors, then the products of what is left of them after the mean is taken off: one matrix of
d x d numbers per partition, added up by Spark, so the driver sees d x d numbers whatever the number of vectors.
That covariance goes through FEAST:

* Inertia: the signs of the pivots of LDL' of the shifted matrix tell how many eigenvalues lie above a shift.
  Bisection on that count finds the gaps that cut the leading eigenvalues into intervals.
* Projection: Gauss-Legendre quadrature along a circle through an interval's ends, with one complex shifted solve per
  node, projects random vectors onto the eigenvectors of the interval.
* Rayleigh-Ritz on the projected vectors gives eigenpairs; projection is repeated until the residuals are at
  rounding level. The inertia count then tells whether any pair is missing; if so, more vectors are projected.

Numbers are shifted by a large offset (`OFFSET`), so sums are exact integers and products are taken only of centred
values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evkit.llm.common import whole_row, with_new

SCALE = 1024.0
OFFSET = 100_000
COMPONENTS = 8
PER_INTERVAL = 4
NODES = 16
ROUNDS = 40
# Eigenvalues below this share of the trace count as zero: there is nothing to whiten along them.
LEAST_SHARE = 1e-12
# Larger entries do not fit in a long after scaling.
LARGEST = float(1 << 50)
PARTIAL = "size int, i int, j int, n long, whole long, part double"


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed `shift`: positive pivots of LDL' (Sylvester's inertia).

    Pivots are single entries or 2 x 2 blocks (which have one eigenvalue of each sign), the larger way each time.
    """
    left = matrix - shift * np.eye(len(matrix))
    positive = 0
    alpha = (1 + np.sqrt(17)) / 8
    while len(left):
        diagonal = np.abs(np.diag(left))
        k = int(np.argmax(diagonal))
        off = np.abs(left - np.diag(np.diag(left)))
        i, j = np.unravel_index(int(np.argmax(off)), off.shape)
        if diagonal[k] == 0 and off[i, j] == 0:
            return positive
        if diagonal[k] >= alpha * off[i, j]:
            chosen = [k]
            positive += int(left[k, k] > 0)
        else:
            chosen = sorted((int(i), int(j)))
            positive += 1
        rest = np.setdiff1d(np.arange(len(left)), chosen)
        cross = left[np.ix_(rest, chosen)]
        left = left[np.ix_(rest, rest)] - cross @ np.linalg.solve(left[np.ix_(chosen, chosen)], cross.T)
        left = (left + left.T) / 2
    return positive


def _bounds(matrix: np.ndarray) -> tuple[float, float]:
    """Gershgorin's: all eigenvalues lie strictly between."""
    spread = np.abs(matrix).sum(1) - np.abs(np.diag(matrix))
    low, high = (np.diag(matrix) - spread).min(), (np.diag(matrix) + spread).max()
    margin = 0.01 * max(high - low, abs(high), 1e-300)
    return float(low - margin), float(high + margin)


def _eigenvalue(matrix: np.ndarray, k: int, low: float, high: float) -> tuple[float, float]:
    """An interval as narrow as rounding allows around the k-th largest eigenvalue."""
    for _ in range(60):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        if count_above(matrix, middle) >= k:
            low = middle
        else:
            high = middle
    return low, high


def intervals(matrix: np.ndarray, wanted: int, per: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the top down, cut at gaps, until `wanted` eigenvalues are inside.

    A cluster of eigenvalues that no gap divides stays in one interval.
    """
    d = len(matrix)
    bottom, top = _bounds(matrix)
    out, done, ceiling = [], 0, top
    while done < min(wanted, d):
        k = min(done + per, wanted, d)
        while k < d:
            upper, _ = _eigenvalue(matrix, k, bottom, ceiling)
            _, lower = _eigenvalue(matrix, k + 1, bottom, ceiling)
            if upper - lower > 1e-9 * (top - bottom):
                break
            k += 1
        floor = (upper + lower) / 2 if k < d else bottom
        out.append((floor, ceiling, k - done))
        done, ceiling = k, floor
    return out


def _project(matrix: np.ndarray, vectors: np.ndarray, low: float, high: float, nodes: int) -> np.ndarray:
    """The vectors' parts in the eigenvectors of [low, high], by quadrature over the upper half circle."""
    centre, radius = (low + high) / 2, (high - low) / 2
    at, weight = np.polynomial.legendre.leggauss(nodes)
    out = np.zeros_like(vectors)
    for x, w in zip(at, weight):
        turn = np.exp(1j * np.pi / 2 * (x + 1))
        shifted = (centre + radius * turn) * np.eye(len(matrix)) - matrix
        out += 0.5 * w * np.real(radius * turn * np.linalg.solve(shifted, vectors.astype(complex)))
    return out


def feast(matrix: np.ndarray, low: float, high: float, inside: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """The `inside` eigenvalues in [low, high], falling, and their eigenvectors as columns."""
    d = len(matrix)
    rng = np.random.default_rng(11)
    size = float(np.abs(matrix).max()) or 1.0
    width = min(d, inside + max(4, inside // 2))
    while True:
        vectors = rng.normal(size=(d, width))
        best = None
        for _ in range(ROUNDS):
            basis, _ = np.linalg.qr(_project(matrix, vectors, low, high, nodes))
            values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
            vectors = basis @ turned
            within = (values > low) & (values < high)
            if within.sum() >= inside:
                # Ritz values of vectors outside the interval may lie in it; true ones have small residuals.
                left = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
                picked = np.flatnonzero(within)
                picked = picked[np.argsort(left[picked], kind="stable")[:inside]]
                worst = float(left[picked].max())
                if best is None or worst < best[0]:
                    best = (worst, values[picked], vectors[:, picked])
                elif worst <= 1e-12 * size * d:
                    break
                if worst <= 1e-15 * size * d:
                    break
        if best is not None and best[0] <= 1e-10 * size * d:
            order = np.argsort(-best[1], kind="stable")
            return best[1][order], best[2][:, order]
        if width == d:
            raise ArithmeticError(f"FEAST finds fewer than the {inside} eigenvalues counted in [{low}, {high}]")
        width = min(d, 2 * width)


def leading(matrix: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and unit eigenvectors as columns."""
    size = float(np.abs(matrix).max()) if matrix.size else 0.0
    if not size:
        return np.zeros(0), np.zeros((len(matrix), 0))
    scaled = matrix / size
    found = [feast(scaled, *part) for part in intervals(scaled, wanted)]
    values = np.concatenate([f[0] for f in found])[:wanted] * size
    return values, np.concatenate([f[1] for f in found], axis=1)[:, :wanted]


@dataclass(frozen=True)
class Whitening:
    """What a fit learned about vectors of one length."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, grid: np.ndarray) -> np.ndarray:
        return (self.n * grid - self.sums) / float(self.n)

    def whitened(self, grid: np.ndarray) -> np.ndarray:
        return self.centred(grid) @ self.vectors / np.sqrt(self.values)

    def deviation(self, grid: np.ndarray) -> np.ndarray:
        """Exact, also where 64 bits hold the sum but no product on the way; larger sums raise."""
        off = self.n * grid - self.sums
        if float(np.abs(off.astype("float64")).max(initial=0.0)) ** 2 * grid.shape[1] < 2.0**62:
            return (off * off).sum(1)
        return np.array([sum(int(x) ** 2 for x in row) for row in off], dtype="int64")


def usable(vector: Column) -> Column:
    """The vector as doubles, or null if it is null, empty, or holds null, non-finite or over-large entries."""
    values = vector.cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return F.when(fine & (F.size(values) > 0), values)


def _grids(column: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, integer vectors) of each length in a batch."""
    sizes = column.map(len).to_numpy(dtype="int64") if len(column) else np.zeros(0, "int64")
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        rows = np.stack([np.asarray(v, dtype="float64") for v in column.iloc[places]])
        yield int(size), places, np.floor(SCALE * rows).astype("int64") + OFFSET


def _total(vectors: DataFrame, measure) -> pd.DataFrame:
    """Sum over all rows of what `measure(size, grid)` makes of each batch: arrays (whole (d,), part (m, m)).

    Each task adds up its batches; Spark adds up the tasks.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for frame in frames:
            for size, _, grid in _grids(frame["values"]):
                whole, part = measure(size, grid)
                if size in held:
                    held[size] = [held[size][0] + len(grid), held[size][1] + whole, held[size][2] + part]
                else:
                    held[size] = [len(grid), whole, part]
        for size, (n, whole, part) in held.items():
            # Sums have no j; the count goes with the first of them.
            places, m = np.arange(len(whole)), len(part)
            yield pd.DataFrame({"size": size, "i": places, "j": -1, "n": np.where(places == 0, n, 0),
                                "whole": whole, "part": 0.0})
            i, j = np.divmod(np.arange(m * m), max(1, m))
            yield pd.DataFrame({"size": size, "i": i, "j": j, "n": 0, "whole": 0, "part": part.ravel()})

    partial = vectors.mapInPandas(run, PARTIAL)
    total = partial.groupBy("size", "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "whole", "part")])
    # One row per entry of a length's sums and products: d + d * d, whatever the number of vectors.
    return total.toPandas()


def _square(found: pd.DataFrame, size: int) -> np.ndarray:
    part = found[(found["size"] == size) & (found["j"] >= 0)].sort_values(["i", "j"])["part"].to_numpy()
    m = int(round(np.sqrt(len(part))))
    return part.reshape(m, m)


def fit_whitening(docs: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> dict[int, Whitening]:
    """For each length of vectors in `docs`, the mean, the leading components and how white they make its vectors.

    Lengths are few; each costs the driver d * d numbers. Components along which the vectors do not vary are left
    out, so a single vector has none. Without usable vectors there are no lengths.
    """
    vectors = docs.select(usable(F.col(vector)).alias("values")).filter("values IS NOT NULL")
    none = np.zeros((0, 0))
    sums = _total(vectors, lambda size, grid: (grid.sum(0), none))
    out: dict[int, Whitening] = {}
    for size in sorted(set(sums["size"])):
        own = sums[sums["size"] == size].sort_values("i")
        out[int(size)] = Whitening(int(own["n"].sum()), own["whole"].to_numpy(dtype="int64"), np.zeros(0),
                                   np.zeros((int(size), 0)), 0.0)

    def products(size: int, grid: np.ndarray):
        centred = out[size].centred(grid)
        return np.zeros(0, "int64"), centred.T @ centred

    found = _total(vectors, products)
    for size, made in out.items():
        covariance = _square(found, size) / made.n
        covariance = (covariance + covariance.T) / 2
        trace = float(np.trace(covariance))
        values, columns = leading(covariance, min(components, size))
        real = values > LEAST_SHARE * trace
        out[size] = Whitening(made.n, made.sums, values[real], columns[:, real], trace)

    def whiteness(size: int, grid: np.ndarray):
        # A column of ones beside the whitened values sums them.
        white = np.column_stack([out[size].whitened(grid), np.ones(len(grid))])
        return np.zeros(0, "int64"), white.T @ white

    found = _total(vectors, whiteness)
    for size, made in out.items():
        both = _square(found, size) / made.n
        mean = both[:-1, -1]
        error = np.abs(both[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean)))
        out[size] = Whitening(made.n, made.sums, made.values, made.vectors, made.trace, float(error.max(initial=0.0)))
    return out


def whiten(docs: DataFrame, fitted: dict[int, Whitening], vector: str = "embedding") -> DataFrame:
    """The rows of `docs` with a usable vector, with all columns, plus `n`, `deviation`, `whitened`, `explained`,
    `identity_error`; the third and fourth are arrays with one number per component.

    Vectors of a length that the fit did not see get null. Repeated rows are whitened alike, and so are rows
    without an id. Columns with the new names are replaced. An empty table gives an empty table.
    """
    @F.pandas_udf("n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    def apply(column: pd.Series) -> pd.DataFrame:
        rows: list = [(None, None, None, None, None)] * len(column)
        for size, places, grid in _grids(column):
            made = fitted.get(size)
            if made is None:
                continue
            explained = made.values / made.trace if made.trace else made.values
            for place, off, white in zip(places, made.deviation(grid), made.whitened(grid)):
                rows[place] = (made.n, int(off), white, explained, made.identity_error)
        names = ["n", "deviation", "whitened", "explained", "identity_error"]
        return pd.DataFrame(rows, columns=names).astype({"n": "Int64", "deviation": "Int64"})

    rows = docs.select(whole_row(docs), usable(F.col(vector)).alias("values")).filter("values IS NOT NULL")
    new = ["n", "deviation", "whitened", "explained", "identity_error"]
    rows = rows.withColumn("made", apply("values")).select("row", "made.*")
    return with_new(rows, new)
