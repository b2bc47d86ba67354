"""Whitening components of embeddings by shifted CholeskyQR: distributed Gram passes and triangular solves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import SLICE_ROWS, give_back
from quillmill.llm.topk import usable

SCALE = 1024
OFFSET = 100_000
#: Whole numbers stay within this, so that they are exact as doubles.
REACH = float(1 << 52)
#: Passes after which rows are as orthogonal as they get: a shifted one and two plain ones do, unless columns depend on each other.
PASSES = 5
#: Largest entry of the Gram matrix less the identity at which rows count as orthogonal.
CLOSE = 1e-13


def whole_rows(vectors: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as whole numbers; entries that a shorter vector lacks count as zero."""
    flat = np.asarray(vectors.flatten(), np.float64)
    sizes = np.diff(np.asarray(vectors.offsets))
    if (sizes != width).any():
        filled = np.zeros((len(sizes), width))
        filled[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        flat = filled
    return (np.clip(np.floor(SCALE * flat), -REACH, REACH) + OFFSET).astype(np.int64).reshape(len(sizes), width)


def summed(parts: DataFrame) -> dict[int, float | int]:
    """The sums of cells over all tasks; cells are as many as a fixed function of the width."""
    return {r["cell"]: r["value"] for r in parts.groupBy("cell").agg(F.sum("value").alias("value")).collect()}


def sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows and each dimension's exact sum, whose high and low halves are added apart."""

    def run(batches):
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                x = whole_rows(batch.column(0).slice(at, SLICE_ROWS), width)
                n += len(x)
                high += (x >> 20).sum(axis=0)
                low += (x & 0xFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * width + 1)), pa.array(np.concatenate([[n], high, low]).astype(np.int64))],
                                         names=["cell", "value"])
        give_back()

    found = summed(rows.select("vector").mapInArrow(run, "cell long, value long"))
    return found.get(0, 0), [(found.get(1 + i, 0) << 20) + found.get(1 + width + i, 0) for i in range(width)]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """Rows less the mean, which is taken off in whole numbers first, so that nothing cancels."""
    whole = np.array([t // n for t in total], np.int64)
    rest = np.array([(t % n) / n for t in total])
    return (x - whole).astype(np.float64) - rest


def gram(rows: DataFrame, width: int, n: int, total: list[int], factors: list[np.ndarray], onto: np.ndarray | None = None) -> np.ndarray:
    """The Gram matrix of the centred rows after a triangular solve by each factor, or of their product with ``onto``.

    Each task sums its own rows' matrix; a matrix has width² cells, whatever the number of rows.
    """
    size = width if onto is None else onto.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((total, factors, onto))

    def run(batches):
        total, factors, onto = shared.value
        found = np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                found += square(solved(centred(whole_rows(batch.column(0).slice(at, SLICE_ROWS), width), n, total), factors), onto)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(found.ravel())], names=["cell", "value"])
        give_back()

    cells = summed(rows.select("vector").mapInArrow(run, "cell long, value double"))
    found = np.zeros(size * size)
    for cell, value in cells.items():
        found[cell] = value
    found = found.reshape(size, size)
    return (found + found.T) / 2


def square(rows: np.ndarray, onto: np.ndarray | None) -> np.ndarray:
    rows = rows if onto is None else rows @ onto
    return rows.T @ rows


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverse of each upper triangular factor, by substitution column for column."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(r.shape[0]):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def factor(g: np.ndarray, n: int, first: bool) -> np.ndarray:
    """The upper Cholesky factor; shifted in the first pass, and later where columns that depend on each other ask for it."""
    d = len(g)
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(g, 2)
    if not first:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            shift = max(shift, np.finfo(float).tiny)
    return np.linalg.cholesky(g + shift * np.eye(d)).T


def root_of(g: np.ndarray) -> np.ndarray:
    """A matrix whose Gram matrix is ``g``, also where ``g`` is singular."""
    values, vectors = np.linalg.eigh(g)
    return np.sqrt(np.maximum(values, 0.0))[:, None] * vectors.T


@dataclass(frozen=True)
class Whitening:
    """Mean (as exact sums and a count), components as columns, and what they explain."""

    n: int
    total: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int

    def weights(self, k: int) -> np.ndarray:
        """Centred rows times this are whitened; a direction without variance gives zeros."""
        e = self.values[:k]
        scale = np.where(e > 0, 1 / np.sqrt(np.where(e > 0, e, 1.0)), 0.0)
        return self.components[:, :k] * scale


def fit(rows: DataFrame, width: int) -> Whitening | None:
    """Fits the components of ``rows`` (vector); None for an empty table.

    The centred rows A are orthogonalised pass by pass: the Gram matrix of
    A R1^-1 ... Ri^-1 gives the next triangular factor.  The factors' product R has
    R'R = A'A without A'A ever being decomposed, so small directions keep their
    digits.  The singular values and right vectors of R are those of A.
    """
    n, total = sums(rows, width)
    if not n:
        return None
    factors: list[np.ndarray] = []
    g = gram(rows, width, n, total, factors)
    trace = float(np.trace(g)) / n
    if trace == 0.0:
        return Whitening(n, total, np.eye(width), np.zeros(width), 0.0, 1)
    while np.abs(g - np.eye(width)).max() > CLOSE and len(factors) < PASSES:
        factors.append(factor(g, n, first=not factors))
        g = gram(rows, width, n, total, factors)
    r = root_of(g)  # the identity, but for directions without variance
    for f in reversed(factors):
        r = r @ f
    _, s, vt = np.linalg.svd(r)
    values = s ** 2 / n
    values[s <= s[0] * np.finfo(float).eps * max(width, 1)] = 0.0
    return Whitening(n, total, vt.T, values, trace, len(factors) + 1)


def width_of(rows: DataFrame) -> int:
    return rows.agg(F.max(F.size("vector"))).first()[0] or 0


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum of the squared deviations times n² of each row, exact; none where a long does not hold it."""
    largest = int(np.abs(x).max(initial=0)) * n + max(map(abs, total), default=0)
    if largest * largest * max(len(total), 1) < 1 << 62:
        off = n * x - np.array(total, np.int64)
        return (off * off).sum(axis=1).tolist()
    whole = np.array([t // n for t in total], np.int64)
    rest = np.array([t % n for t in total], object)
    off = (x - whole).astype(object) * n - rest
    return [int(v) if v < 1 << 63 else None for v in (off * off).sum(axis=1)]


def whiten(vectors: DataFrame, k: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component up to ``k``.

    Null vectors and vectors with null or non-finite entries take no part; a null
    key stays null and repeated rows each count.  Entries become
    floor(1024 c) + 100000, entries beyond 2^52 being cut to it.  Shorter vectors
    are read as if filled with zeros; with fewer than ``k`` dimensions there are
    fewer components.  Equal eigenvalues share their space in any order.  A
    direction without variance whitens to zero and explains nothing; it shows in
    ``identity_error``, one value for the table, measured in a pass of its own.
    ``deviation`` is null where a long does not hold it.  An empty table gives no
    rows; other columns, whatever their names, take no part.

    The components are fitted once, on matrices of width² cells, so all rows get
    the same; the driver holds a few of these.
    """
    rows = usable(vectors, vector).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = width_of(rows)
    model = fit(rows, width) if width else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k = min(k, width)
    weights = model.weights(k)
    error = float(np.abs(gram(rows, width, model.n, model.total, [], weights) / model.n - np.eye(k)).max())
    explained = model.values[:k] / model.trace if model.trace else np.zeros(k)
    shared = vectors.sparkSession.sparkContext.broadcast((model.n, model.total, weights, explained))
    kinds = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                       ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches):
        n, total, weights, explained = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                x = whole_rows(part.column(1), width)
                m = len(x)
                each = np.repeat(np.arange(m), k)
                deviation = pa.array(deviations(x, n, total), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, n)), deviation.take(pa.array(each)),
                     pa.array((centred(x, n, total) @ weights).ravel()), pa.array(np.tile(explained, m)),
                     pa.array(np.full(m * k, error))], schema=kinds)
        give_back()

    return rows.mapInArrow(run, schema)
