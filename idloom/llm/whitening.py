"""Whitening of embeddings: exact whole-number sums on Spark, eigenpairs of the covariance by contour integration.

Entries become whole numbers, so counts, sums and the covariance's sums are exact, in whatever order tasks add them.
Only tables of the dimension's square come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm.common import blocks, clearing, map_arrow, map_batches, prepare, saved
from idloom.llm.feast import largest_pairs

SCALE, SHIFT = 64, 1_000_000
#: Doubles beyond this are taken as this: there they have no digits after the point, and no sum below leaves its type.
_MOST = 2.0**52
_EXACT, _LONG = 1 << 53, 1 << 63


def _usable(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of vectors without null or non-finite entries, and their whole numbers as a matrix."""
    col = batch.column(at)
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = col.flatten()
    bad = pc.is_null(values).to_numpy(zero_copy_only=False) | ~np.isfinite(flat := pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.float64))
    faults = np.concatenate(([0], np.cumsum(bad)))
    ends = np.cumsum(sizes)
    good = np.flatnonzero((sizes > 0) & (faults[ends] == faults[ends - sizes]))
    width = np.unique(sizes[good])
    if len(width) > 1:
        raise ValueError(f"vectors of different lengths: {width[0]} and {width[-1]} entries")
    if not len(good):
        return good, np.zeros((0, 0), np.int64)
    with np.errstate(over="ignore"):  # what becomes infinite is cut
        scaled = np.floor(SCALE * flat[(ends - sizes)[good][:, None] + np.arange(width[0])])
    return good, np.clip(scaled, -_MOST, _MOST).astype(np.int64) + SHIFT


def _points(batch: pa.RecordBatch) -> pa.RecordBatch:
    x = _usable(batch, 0)[1]
    return pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.int64).reshape(len(col), -1)


def _sums(batches):
    """Of a task's points: how many, their least and largest length, and the sum of each dimension."""
    n, total, widths = 0, None, set()
    for batch in batches:
        for b in blocks(batch):
            widths |= set(pc.binary_length(b.column(0)).unique().to_pylist())
            if len(widths) > 1:
                raise ValueError(f"vectors of different lengths: {min(widths) // 8} and {max(widths) // 8} entries")
            x = _matrix(b.column(0))
            n += len(x)
            total = x.sum(axis=0).astype(object) + (0 if total is None else total)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([list(map(str, total.tolist()))], pa.list_(pa.string()))], names=["n", "s"])


def _products(x: np.ndarray) -> np.ndarray:
    """x.T @ x of whole numbers, exact: in doubles where all sums stay below 2 ** 53."""
    most = int(np.abs(x).max(initial=0))
    if most * most * len(x) < _EXACT:
        f = x.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    x = x.astype(object)
    return x.T @ x


def _gram(middle: np.ndarray):
    def run(batches):
        total = None
        for batch in batches:
            for b in blocks(batch):
                g = _products(_matrix(b.column(0)) - middle)
                total = g if total is None else total + g
        if total is not None:
            rows = [list(map(str, r)) for r in total.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(rows, pa.list_(pa.string()))], names=["i", "g"])

    return run


class Whitener:
    """n points with sums S; eigenvalues of their covariance, falling, and unit eigenvectors; the covariance's trace."""

    def __init__(self, n: int, sums: list[int], gram: list[list[int]], most: int):
        self.n = n
        self.middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)  # the mean, rounded
        self.rest = [s - n * int(m) for s, m in zip(sums, self.middle, strict=True)]
        # Sums of products about the rounded mean, moved to the mean itself: whole numbers until the one division.
        v = np.array([[(n * g - a * b) / (n * n) for g, b in zip(row, self.rest, strict=True)] for row, a in zip(gram, self.rest, strict=True)], float).reshape(len(sums), len(sums))
        self.trace = float(np.trace(v))
        self.values, self.vectors = largest_pairs(v, most)
        self.shift = np.array([r / n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle) - self.shift) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2 over the dimensions; null beyond a long."""
        c = x - self.middle
        most = self.n * int(np.abs(c).max(initial=0)) + max(map(abs, self.rest), default=0)
        if most * most * max(1, x.shape[1]) < _LONG:
            return ((self.n * c - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * c.astype(object) - np.array(self.rest, object)) ** 2).sum(axis=1)
        return [v if v < _LONG else None for v in exact.tolist()]


def fit(points: DataFrame, most: int) -> Whitener | None:
    """The whitener of a table of distinct points; None for an empty one. Sums are of whole numbers, so the order of rows is no matter."""
    told = map_arrow(points, _sums, "n bigint, s array<string>")
    told = told.select("n", F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rows = sorted(told.collect())  # a row for each dimension
    if not rows:
        return None
    if len({r["n"] for r in rows}) > 1:
        raise ValueError("vectors of different lengths")
    n, sums = rows[0]["n"], [int(r["s"]) for r in rows]
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    parts = map_arrow(points, _gram(middle), "i int, g array<string>").select("i", F.posexplode("g").alias("j", "g"))
    d = len(sums)
    gram = [[0] * d for _ in range(d)]
    for r in parts.groupBy("i", "j").agg(F.sum(F.col("g").cast("decimal(38,0)")).alias("g")).collect():  # the dimension's square
        gram[r["i"]][r["j"]] = int(r["g"])
    return Whitener(n, sums, gram, most)


def _identity_error(points: DataFrame, w: Whitener) -> float:
    """Largest entry of the covariance of all points' whitened values, less the identity."""
    k = len(w.values)

    def run(batches):
        total, products, n = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            for b in blocks(batch):
                y = w.whitened(_matrix(b.column(0)))
                total, products, n = total + y.sum(axis=0), products + y.T @ y, n + len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total, products.ravel()]).tolist()], pa.list_(pa.float64()))], names=["v"])

    sums = map_arrow(points, run, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.array([r["v"] for r in sorted(sums)]) / w.n
    mean, products = flat[:k], flat[k:].reshape(k, k)
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, most: int = 16, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per usable row of vectors and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty, or holds null or non-finite entries, are dropped. An entry c counts as
    floor(64 * c) + 1000000, cut to 2 ** 52 either way. The covariance is that of the distinct vectors. Components
    are numbered from 1 by falling eigenvalue; there are fewer than `most` if fewer eigenvalues are above rounding, so equal
    vectors, a single one or an empty table give no rows. Repeated rows and keys, and null keys, give rows of their own; extra
    columns are ignored. deviation is null where it exceeds a long. Vectors of different lengths raise ValueError.
    """
    spark = vectors.sparkSession
    prepare(spark)
    slim = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    out = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    with clearing(spark):
        points = saved(map_batches(slim.select("v"), _points, "x binary").distinct(), "points")
        w = fit(points, most)
        if w is None or not len(w.values):
            return spark.createDataFrame([], out)
        error = _identity_error(points, w)
    k, explained = len(w.values), w.values / w.trace

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        good, x = _usable(batch, 1)
        ids = batch.column(0).take(pa.array(np.repeat(good, k)))
        if not len(good):
            x = np.zeros((0, len(w.middle)), np.int64)
        dev, m = pa.array(w.deviation(x), pa.int64()), len(good) * k
        cols = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(good))), pa.array(np.full(m, w.n)), dev.take(pa.array(np.repeat(np.arange(len(good)), k))), pa.array(w.whitened(x).ravel()), pa.array(np.tile(explained, len(good))), pa.array(np.full(m, error))]
        return pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_batches(slim, rows, out)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 components of every usable row of embeddings: see whiten."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op12_embedding_whitening": op12_embedding_whitening}
ORACLE_SQL: dict[str, str] = {}
