"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.session import staged

SCALE = 256  # entries become floor(SCALE * entry)
SURE = 8  # steps from a new direction after which converged components count as the largest
TINY = 1e-13  # relative size of what rounding leaves of a zero
FAINT = 1e-7  # the same of a length that is the root of a sum
SAFE = 1 << 62


@dataclass
class Components:
    """What was fitted on vectors of one length: `axes` has a unit row per component, `variances` falls."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    total: float

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole_numbers(vector: Column) -> Column:
    """A vector as whole numbers; null where it is null or holds a null or non-finite entry."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("bigint") + F.lit(0).cast("bigint"))
    return F.when(fine, scaled)


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dims)


def _column_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of every dimension, added up as whole numbers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            x = _matrix(batch["x"], dims)
            if not len(x):
                continue
            top = max(abs(int(x.max())), abs(int(x.min())))
            total += (x if top * len(x) < SAFE else x.astype(object)).sum(axis=0).astype(object)
            n += len(x)
        values = [n, *(int(t) for t in total)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array([str(v) for v in values])], ["i", "v"])

    parts = fit.select("x").mapInArrow(sums, "i int, v string")
    rows = parts.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")).collect()
    found = {r["i"]: int(r["v"]) for r in rows}
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(dims)]


def _sums(fit: DataFrame, mean: np.ndarray, width: int, measure: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """`measure` of centred rows, added up over all of `fit` in one pass: a task hands on one row of `width` sums."""
    dims, names = len(mean), [f"s{i}" for i in range(width)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            total += measure(_matrix(batch["x"], dims) - mean)
        yield pa.RecordBatch.from_arrays([pa.array([t]) for t in total], names)

    parts = fit.select("x").mapInArrow(add, ", ".join(f"{n} double" for n in names))
    return np.array([v or 0.0 for v in parts.agg(*(F.sum(n) for n in names)).first()])


def _product(fit: DataFrame, mean: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Xᵀ(Xw) for the centred rows X."""
    return _sums(fit, mean, len(mean), lambda x: (x @ vector) @ x)


def _orthogonal(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):  # twice is enough
        for b in basis:
            vector = vector - (b @ vector) * b
    return vector


def bidiagonalise(fit: DataFrame, mean: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest singular values of the centred rows X and their right singular vectors.

    Step j takes u = Xv - βu' and then Xᵀu - αv. A left vector u has an entry per row and is never
    stored: it is X times a short vector of coefficients, so that one pass over the rows gives Xᵀu, and
    |u|² is the product of the two. Both sides are held orthogonal to all earlier vectors, the left ones
    through the products Xᵀu that are known. Steps end when the residuals of the wanted triplets vanish
    and SURE steps from a new random direction have not found a larger one, or when the space is spanned.
    """
    dims = len(mean)
    random = np.random.default_rng(0)
    right, coefficients, left_products = [], [], []
    alphas, betas = [], []  # diagonal, and what couples step j with j + 1
    v = _orthogonal(random.normal(size=dims), [])
    v /= np.linalg.norm(v)
    settled: np.ndarray | None = None
    since = 0
    while len(right) < dims:
        w = v.copy()
        if right and betas[-1]:
            w -= betas[-1] * coefficients[-1]
        product = _product(fit, mean, w)
        # the part of u along earlier left vectors goes, twice, on coefficients and products alike
        for _ in range(2):
            for c, known in zip(coefficients, left_products, strict=True):
                along = c @ product
                w, product = w - along * c, product - along * known
        alpha = float(np.sqrt(max(w @ product, 0.0)))
        right.append(v)
        largest = max([alpha, *alphas])
        if alpha <= FAINT * largest or not alpha:
            alpha = 0.0
            coefficients.append(np.zeros(dims))
            left_products.append(np.zeros(dims))
        else:
            coefficients.append(w / alpha)
            left_products.append(product / alpha)
        alphas.append(alpha)
        if len(right) == dims:
            break
        z = _orthogonal(left_products[-1], right)
        beta = float(np.linalg.norm(z))
        values, leftmost = _small_svd(alphas, betas)
        wanted = min(count, len(values))
        residual = beta * np.abs(leftmost[-1, :wanted]).max() if wanted == count else np.inf
        if residual <= TINY * max(values[0], 1e-300):
            if settled is None or not np.allclose(values[:count], settled, rtol=1e-9, atol=TINY * values[0]):
                settled, since, beta = values[:count].copy(), 0, 0.0  # look once more, from elsewhere
            elif since >= SURE:
                break
        since += 1
        if beta <= TINY * max(values[0], 1e-300):
            z = _orthogonal(random.normal(size=dims), right)
            v, beta = z / np.linalg.norm(z), 0.0
        else:
            v = z / beta
        betas.append(beta)
    values, _, axes = _small_svd(alphas, betas, vectors=True)
    axes = axes @ np.array(right)
    return values[:count], axes[:count]


def _small_svd(alphas: list[float], betas: list[float], vectors: bool = False):
    """SVD of the small upper bidiagonal matrix."""
    small = np.diag(alphas) + (np.diag(betas[: len(alphas) - 1], 1) if len(alphas) > 1 else 0)
    left, values, right = np.linalg.svd(small)
    return (values, left, right) if vectors else (values, left)


def fit_components(fit: DataFrame, dims: int, count: int) -> Components:
    """Components of the distinct vectors `x` of one length."""
    n, sums = _column_sums(fit, dims)
    if not n or not dims:
        return Components(n, sums, np.zeros((0, dims)), np.zeros(0), 0.0)
    mean = np.array([s / n for s in sums])
    values, axes = bidiagonalise(fit, mean, min(count, dims))
    variances = values**2 / n
    total = float(_sums(fit, mean, 1, lambda x: np.array([(x * x).sum()]))[0] / n)
    good = variances > TINY * total if total > 0 else np.zeros(len(variances), bool)
    return Components(n, sums, axes[good], variances[good], total)


def identity_error(fit: DataFrame, model: Components) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity."""
    scaled = (model.axes / np.sqrt(model.variances)[:, None]).T
    count = scaled.shape[1]

    def moments(x: np.ndarray) -> np.ndarray:
        z = x @ scaled
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

    found = _sums(fit, model.mean(), count * count + count, moments) / model.n
    middle = found[count * count :]
    covariance = found[: count * count].reshape(count, count) - np.outer(middle, middle)
    return float(np.abs(covariance - np.eye(count)).max(initial=0.0))


def _project(rows: DataFrame, model: Components, error: float, kept: list[str]) -> DataFrame:
    dims, count = len(model.sums), len(model.axes)
    n, sums, mean = model.n, np.array(model.sums, object), model.mean()
    scaled = model.axes / np.sqrt(model.variances)[:, None]
    explained = model.variances / model.total if model.total else model.variances

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["x"], dims)
            top = max(abs(int(x.max())), abs(int(x.min()))) * n + max(abs(int(s)) for s in sums)
            gap = x * n - sums.astype(np.int64) if top * top * dims < SAFE else x.astype(object) * n - sums
            apart = (gap * gap).sum(axis=1)
            row = np.repeat(np.arange(batch.num_rows), count)
            arrays = [batch.column(c).take(pa.array(row)) for c in kept]
            arrays += [
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(len(row), n, np.int64)),
                pa.array([str(apart[r]) for r in row], pa.string()), pa.array(((x - mean) @ scaled.T).ravel()),
                pa.array(np.tile(explained, batch.num_rows)), pa.array(np.full(len(row), error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    made = "component int, n bigint, deviation string, whitened double, explained double, identity_error double"
    out = rows.select(*kept, "x").mapInArrow(project, f"{fields}, {made}")
    return out.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))


def whiten_vectors(vectors: DataFrame, count: int = 4) -> DataFrame:
    """Each vector's whitened coordinates along the `count` largest principal components.

    Entries become whole numbers; mean and components are those of the distinct vectors, so copies weigh
    nothing. Components come from a bidiagonalisation whose passes over the distinct vectors each read
    them once and move one short vector to the tasks and one back.

    Returns vec_id, component (from 1 by falling variance), n (distinct vectors), deviation (squared
    distance from the mean times n², exact, null beyond 38 digits), whitened, explained (share of the variance) and
    identity_error. Rows whose vector is null or has null or non-finite entries are dropped; entries
    beyond the range of a long stop at its ends. Vectors of each length are fitted by themselves. There
    are fewer than `count` components where fewer have variance, so none for a single distinct vector.
    Equal variances have any orthogonal axes of theirs. Repeated rows and null ids keep their rows; other
    columns are ignored; an empty table gives no rows.
    """
    x = whole_numbers(F.col("embedding")).alias("x")
    rows = staged(vectors.select("vec_id", x).where("x is not null and size(x) > 0").withColumn("_dims", F.size("x")))
    out = rows.limit(0).select(
        "vec_id", F.lit(0).alias("component"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"),
        *(F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")),
    )
    for length in sorted(r["_dims"] for r in rows.select("_dims").distinct().collect()):
        same = rows.where(F.col("_dims") == length)
        fit = staged(same.select("x").distinct())
        model = fit_components(fit, length, count)
        if len(model.axes):
            out = out.unionByName(_project(same, model, identity_error(fit, model), ["vec_id"]))
    return out
