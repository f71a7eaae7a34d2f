"""Whitening of embeddings by a one-sided Jacobi SVD behind a blockwise TSQR.

Vectors become whole numbers x, the fit list is each distinct x once, and its count n and sums S are exact. Each task
reduces its share of the centred list, (n*x - S) / n, block by block to one triangular R of d x d (blockwise TSQR); Rs meet
FAN at a time until one is left. Plane rotations orthogonalise R's columns: their lengths are the standard deviations times
sqrt(n), and the rotations, accumulated, are the components. No product of the list with itself is ever formed, so small
components keep their accuracy.

What reaches the driver is d sums, one R and a table of k x k sums, whatever the number of rows. Tasks hold a batch of
vectors and an R. Copies are dropped before the exchange of the fit list, so a vector that a third of all rows have costs
one row a task.

Defined results: rows whose vector is null or holds null or non-finite entries get no rows. Of vectors of several lengths the
length that most have counts (the greater one in a tie), others get no rows. Repeated rows, null and repeated ids get rows
each. Entries beyond 2**46 count as 2**46 of their sign. Components without variance, to the precision of the numbers, are
left out, as nothing can be divided by their deviation; so a table whose vectors are all equal, and an empty one, gives no
rows. A deviation beyond 64 bits is null. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import forget, lean_batches, load, saved

#: x = floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rs that meet in one task.
FAN = 32
#: Rows of a block that joins R at a time, as a multiple of the dimensions.
BLOCK = 8
_LARGEST = float(1 << 52)
_LONG = 1 << 63


@dataclass
class Whitening:
    """Mean as sums over n, components as columns, their variances (falling), and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float


def quantised(rows: DataFrame, column: str = "embedding", name: str = "x") -> DataFrame:
    """rows with whole vectors in place of column; rows without a usable vector are left out."""
    good = F.forall(column, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    held = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(_LARGEST)), F.lit(-_LARGEST))
    out = rows.where(F.col(column).isNotNull() & good).withColumn(name, F.transform(column, lambda c: F.floor(held(c)) + F.lit(SHIFT).cast("long")))
    size = out.groupBy(F.size(name).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return out.where(F.size(name) == (size["size"] if size else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact: of 64-bit integers where they fit, else of Python's."""
    whole = [s // n for s in sums]
    rest = [s - n * w for s, w in zip(sums, whole)]
    y = x - np.array(whole, np.int64)
    if n * (int(np.abs(y).max(initial=0)) + 1) >= _LONG:
        return y.astype(object) * n - np.array(rest, object)
    return y * np.int64(n) - np.array(rest, np.int64)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _deviations(x, n, sums).astype(np.float64) / n


def squared(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)**2, exact; None beyond 64 bits."""
    y = _deviations(x, n, sums)
    if x.shape[1] * int(np.abs(y).max(initial=0)) ** 2 < _LONG:
        return (y * y).sum(axis=1).tolist()
    return [s if s < _LONG else None for s in (int(v) for v in (y.astype(object) ** 2).sum(axis=1))]


def totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Count and sums over dimensions of the vectors x of fit: exact, d rows to the driver."""

    def run(batches):
        n, total = 0, np.zeros(d, object)
        for b in batches:
            x = _matrix(b.column(0), d)
            n += len(x)
            small = len(x) * int(np.abs(x).max(initial=0)) < _LONG
            total += (x if small else x.astype(object)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total.tolist(), pa.decimal128(38, 0)), pa.array([n] * d, pa.int64())], ["dim", "total", "n"])

    rows = fit.select("x").mapInArrow(run, "dim int, total decimal(38,0), n long").groupBy("dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("dim").collect()
    return rows[0]["n"], [int(r["total"]) for r in rows]


def triangle(stack: np.ndarray) -> np.ndarray:
    return np.linalg.qr(stack, mode="r")


def tsqr(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred vectors x of fit."""
    d = len(sums)

    def local(batches):
        r = np.zeros((0, d))
        for b in batches:
            z = centred(_matrix(b.column(0), d), n, sums)
            for k in range(0, len(z), BLOCK * d):
                r = triangle(np.vstack([r, z[k : k + BLOCK * d]]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["part", "r"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        r = triangle(np.vstack([np.asarray(v).reshape(-1, d) for v in pdf["r"]]))
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN], "r": [r.ravel().tolist()]})

    rs = saved(fit.select("x").mapInArrow(local, "part long, r array<double>"), "tsqr")
    while rs.count() > FAN:
        more = saved(rs.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(meet, "part long, r array<double>"), "tsqr")
        forget(rs)
        rs = more
    last = [np.asarray(r["r"]).reshape(-1, d) for r in rs.orderBy("part").collect()]  # FAN of d x d at most
    forget(rs)
    return triangle(np.vstack(last)) if last else np.zeros((0, d))


def _rounds(d: int):
    """Pairs of columns in rounds of disjoint pairs, each pair once; d is even."""
    ring = list(range(d))
    for _ in range(d - 1):
        yield np.array(ring[: d // 2]), np.array(ring[: d // 2 - 1 : -1])
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of r's columns after they have been made orthogonal by plane rotations, falling, and the rotations' product."""
    d = r.shape[1]
    even = d + d % 2
    a, v = np.zeros((len(r), even)), np.eye(even)
    a[:, :d] = r
    eps = np.finfo(float).eps
    floor = (eps * even) ** 2 * max((a * a).sum(axis=0).max(initial=0.0), np.finfo(float).tiny)
    pairs = list(_rounds(even)) if even else []
    for _ in range(sweeps):
        turned = False
        for p, q in pairs:
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            on = (np.abs(xy) > eps * np.sqrt(xx * yy) * 4) & (np.minimum(xx, yy) > floor)
            if not on.any():
                continue
            turned = True
            p, q, x, y, xx, yy, xy = p[on], q[on], x[:, on], y[:, on], xx[on], yy[on], xy[on]
            z = (yy - xx) / (2 * xy)
            t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1, z))
            c = 1 / np.hypot(1, t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            x, y = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    else:
        raise RuntimeError("rotations did not settle")
    size = np.sqrt((a[:, :d] ** 2).sum(axis=0))
    order = np.argsort(-size, kind="stable")
    return size[order], v[:d, :d][:, order]


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct vectors x of a table, and the table of these (saved)."""
    lean_batches(vectors.sparkSession)
    fit = saved(vectors.select("x").distinct(), "fit")
    one = fit.select(F.size("x")).first()
    if not one or not one[0]:
        return None, fit
    n, sums = totals(fit, one[0])
    size, v = jacobi(tsqr(fit, n, sums))
    real = size > size.max(initial=0.0) * np.finfo(float).eps * max(n, len(sums)) ** 0.5 * 4
    k = min(components, int(real.sum()))
    return (Whitening(n, sums, v[:, :k], size[:k] ** 2 / n, float((size**2).sum() / n)) if k else None), fit


def projected(x: np.ndarray, w: Whitening) -> np.ndarray:
    return centred(x, w.n, w.sums) @ w.components / np.sqrt(w.variances)


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity.

    Whitened vectors come from n*x - S, whose sum is exactly zero, so they are centred before they are multiplied.
    """
    d, k = w.components.shape

    def run(batches):
        total = np.zeros((k, k))
        for b in batches:
            y = projected(_matrix(b.column(0), d), w)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], ["cell", "total"])

    rows = fit.select("x").mapInArrow(run, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    cov = np.zeros(k * k)
    for r in rows:
        cov[r["cell"]] = r["total"] / w.n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max())


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, w: Whitening, error: float) -> DataFrame:
    """Rows of WHITENED for each row (vec_id, x) and component."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    d, k = w.components.shape
    schema = to_arrow_schema(_parse_datatype_string(WHITENED))

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), d)
            if not len(x):
                continue
            m = len(x)
            each = np.repeat(np.arange(m), k)
            cols = [
                b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n, np.int64)), pa.array(squared(x, w.n, w.sums), pa.int64()).take(pa.array(each)),
                pa.array(projected(x, w).ravel()), pa.array(np.tile(w.variances / w.trace, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return vectors.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, WHITENED)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    rows = quantised(load(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "x")
    w, fit = fit_whitening(rows)
    if w is None:
        return spark.createDataFrame([], WHITENED)
    out = whiten(rows, w, identity_error(fit, w))
    forget(fit)
    return out
