"""Whitening of embeddings by matrix-free block subspace iteration: each Spark pass multiplies a block by the covariance.

The covariance itself is never formed. A pass reads the centred rows X and returns Xᵀ(XQ) of a block Q, a row for each
dimension; the driver orthonormalises (QR), solves the small Rayleigh-Ritz problem and measures the residuals. The
spaces of earlier passes are kept in the basis, so that close eigenvalues don't take thousands of passes, and a basis
that spans all dimensions is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, tidied

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Residuals, relative to the largest eigenvalue, at which a component counts as found.
TOLERANCE = 1e-12
#: Eigenvalues below this share of the largest one are no components: their vectors are rounding noise.
LEAST = 1e-11
#: Blocks that the basis holds before it restarts from its best vectors; passes after which fitting gives up.
BLOCKS, PASSES = 8, 500


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list, its total variance, and unit eigenvectors (columns) by falling eigenvalue."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int


def integers(df: DataFrame, column: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """``keep`` and x array<long>: rows whose vector is null, empty or holds null or non-finite entries are left out.

    All vectors must have one length; if not, those of the commonest length (of ties, the longest) take part.
    """
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    full = df.where(F.col(column).isNotNull() & (F.size(column) > 0) & F.coalesce(finite, F.lit(False)))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    return full.select(*[F.col(c).alias(c) for c in keep], x.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(df: DataFrame, names: list[str], width: int, kind: str, run: Callable[[Iterator[np.ndarray]], np.ndarray]) -> np.ndarray:
    """Sums over all tasks of a matrix of ``names`` columns that each task makes of its vectors.

    A task gives a row for each line of its matrix, which Spark adds up by line, so what the driver gets depends on the
    number of dimensions only.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = run(_matrix(b.column(0), width) for b in batches if b.num_rows)
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(made), dtype=np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in made.T]], names=["line", *names])

    parts = df.where(F.size("x") == width).select("x").mapInArrow(tidied(task), ", ".join(["line int", *(f"{c} {kind}" for c in names)]))
    rows = parts.groupBy("line").agg(*[F.sum(c).alias(c) for c in names]).orderBy("line").collect()
    return np.array([r[1:] for r in rows])


def _moments(x: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Row count and exact sums by dimension."""

    def run(parts: Iterator[np.ndarray]) -> np.ndarray | None:
        n, sums, most = 0, np.zeros(width, dtype=np.int64), 0.0
        for m in parts:
            n, sums, most = n + len(m), sums + m.sum(axis=0), most + float(np.abs(m.astype(np.float64)).sum())
            if most >= 2.0**62:
                raise ArithmeticError("a sum leaves 64 bits")
        return np.stack([sums, np.full(width, n)], axis=1) if n else None

    made = _summed(x, ["s", "n"], width, "long", run)
    return (int(made[0, 1]), made[:, 0]) if len(made) else (0, np.zeros(width, dtype=np.int64))


def _centred(m: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, exact, and x - S/n, rounded once."""
    if len(m) and n * max(abs(int(m.max())), abs(int(m.min()))) >= 1 << 62:
        raise ArithmeticError("n * x leaves 64 bits")
    exact = n * m - sums
    return exact, exact / n


def _covariance_times(x: DataFrame, n: int, sums: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """Xᵀ(XQ) / n over the centred rows, and the trace of XᵀX / n."""
    width, p = q.shape

    def run(parts: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for m in parts:
            c = _centred(m, n, sums)[1]
            made = np.concatenate([c.T @ (c @ q), (c * c).sum(axis=0)[:, None]], axis=1)
            total = made if total is None else total + made
        return total

    made = _summed(x, [f"v{i}" for i in range(p + 1)], width, "double", run) / n
    return made[:, :p], float(made[:, p].sum())


def _orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, p: int) -> np.ndarray:
    """p unit columns at right angles to the basis and to each other, that begin with the block's; random ones fill up."""
    p = min(p, len(basis) - basis.shape[1])
    size = np.linalg.norm(block, axis=0)
    block = np.concatenate([block[:, size > 0] / size[size > 0], rng.standard_normal((len(basis), p))], axis=1)
    out = np.empty((len(basis), 0))
    for at in range(block.shape[1]):
        if out.shape[1] == p:
            break
        v = block[:, at]
        for _ in range(3):  # again, as what is left may be small
            v = v - basis @ (basis.T @ v) - out @ (out.T @ v)
        size = np.linalg.norm(v)
        if size > 1e-13:
            out = np.concatenate([out, (v / size)[:, None]], axis=1)
    return np.linalg.qr(out)[0]


def fit(x: DataFrame, k: int = 32, more: int = 8, seed: int = 7, tolerance: float = TOLERANCE) -> Whitening | None:
    """The k leading components of the covariance (divisor n) of the frame ``integers`` gives; None without rows.

    Each pass takes a block of k + ``more`` columns, and passes go on until all k residuals |Vu - eu| are under
    ``tolerance`` times the largest eigenvalue or the basis spans all dimensions. Components without variance (under
    LEAST of the first) are left out, so there may be fewer than k. A vector's sign makes its largest entry positive.
    """
    first = x.select(F.size("x").alias("d")).groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if first is None:
        return None
    width = first["d"]
    n, sums = _moments(x, width)
    rng, k = np.random.default_rng(seed), min(k, width)
    p = min(width, k + more)
    basis, image = np.empty((width, 0)), np.empty((width, 0))
    block = _orthonormal(rng.standard_normal((width, p)), basis, rng, p)
    for passes in range(1, PASSES + 1):
        made, trace = _covariance_times(x, n, sums, block)
        basis, image = np.concatenate([basis, block], axis=1), np.concatenate([image, made], axis=1)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, applied = basis @ turn, image @ turn
        off = applied - ritz * values
        residuals = np.linalg.norm(off[:, :k], axis=0)
        if basis.shape[1] == width or residuals.max() <= tolerance * abs(values[0]):
            held = max(values[0], 0) > 0
            vectors, values = ritz[:, :k], values[:k]
            real = (values > LEAST * values[0]) & held
            vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None, :], axis=0) < 0, -1, 1)
            return Whitening(n, sums, trace, values[real], vectors[:, real], residuals[real], passes)
        if basis.shape[1] + p > BLOCKS * p:  # a restart keeps the best vectors and what the covariance made of them
            basis, image = ritz[:, : 2 * p], applied[:, : 2 * p]
        block = _orthonormal(off[:, :p], basis, rng, p)
    raise ArithmeticError(f"no {k} components within {tolerance} after {PASSES} passes")


def _whitened(m: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    exact, c = _centred(m, model.n, model.sums)
    if len(exact) and float(np.abs(exact).max()) ** 2 * exact.shape[1] >= 2.0**63:
        raise ArithmeticError("a deviation leaves 64 bits")
    return (exact * exact).sum(axis=1), c @ (model.vectors / np.sqrt(model.values))


def identity_error(x: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, measured on all rows."""
    width, k = len(model.sums), len(model.values)

    def run(parts: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for m in parts:
            y = _whitened(m, model)[1]
            made = np.concatenate([y.T @ y, y.sum(axis=0)[:, None]], axis=1)
            total = made if total is None else total + made
        return total

    made = _summed(x, [f"v{i}" for i in range(k + 1)], width, "double", run) / model.n
    return float(np.abs(made[:, :k] - np.outer(made[:, k], made[:, k]) - np.eye(k)).max())


def transform(x: DataFrame, model: Whitening) -> DataFrame:
    """``x``'s rows (vec_id, x) with deviation long and whitened array<double>, an entry for each component."""
    width, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            deviation, y = _whitened(_matrix(b.column(1), width), model)
            starts = pa.array(np.arange(0, (b.num_rows + 1) * k, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation), pa.ListArray.from_arrays(starts, pa.array(y.ravel()))], names=["vec_id", "deviation", "whitened"])

    return x.where(F.size("x") == width).select("vec_id", "x").mapInArrow(tidied(run), "vec_id long, deviation long, whitened array<double>")


def whiten(embeddings: DataFrame, k: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null, empty, or hold null or non-finite entries take no part, nor do those whose length isn't the
    commonest (of ties, the longest). Null vec_ids stay; repeated rows count and return as often as they stand. Equal
    eigenvalues leave their vectors' directions open within their space. Components without variance are left out: all
    vectors equal, or one vector only, give no rows, nor does an empty table. Entries whose n * x or deviation leaves
    64 bits raise ArithmeticError. Other columns are not read.
    """
    spark = embeddings.sparkSession
    x = scratch(integers(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")), "whiten-x")
    model = fit(x, k)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(x, model)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    rows = transform(x, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
