"""Embeddings whitened on their largest components: exact sums on Spark, the components by contour integration.

Entries go to a grid of whole numbers, so the distinct vectors (the fit list), their number and their sums are exact. Tasks add
up their centred products, and only sums go further, one number for each pair of dimensions. The components come from
``feast.largest``. The whitened coordinates of the fit list are then measured once more: the largest entry of their covariance
minus the identity stands beside the results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileguard.llm.common import stored
from fileguard.llm.feast import largest

COMPONENTS = 16
GRID = 64
SHIFT = 1_000_000
#: Magnitude from which an entry has no place on the grid.
BEYOND = float(1 << 30)
ROWS_AT_ONCE = 4096
RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def on_grid(column: pa.Array | pa.ChunkedArray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``d`` finite entries, and their entries as whole numbers (rows, d)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(pa.compute.list_value_length(column).fill_null(-1))
    right = np.flatnonzero(sizes == d)
    entries = column.take(pa.array(right)).flatten()
    values = entries.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(right), d)
    fine = (np.abs(values) < BEYOND).all(axis=1)
    return right[fine], np.floor(values[fine] * GRID).astype(np.int64) + SHIFT


def grid(batch_column: pa.Array, d: int) -> np.ndarray:
    """Entries (rows, d) of a column of whole vectors."""
    if isinstance(batch_column, pa.ChunkedArray):
        batch_column = batch_column.combine_chunks()
    return batch_column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))


def off_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in 64 bits where they suffice, else in Python's numbers."""
    most = max((abs(n * v - s) for lo, hi, s in zip(x.min(axis=0, initial=0).tolist(), x.max(axis=0, initial=0).tolist(), sums, strict=True) for v in (lo, hi)), default=0)
    if max(most, max(map(abs, sums), default=0), n * int(np.abs(x).max(initial=0))) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(off: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; null where they pass 64 bits."""
    most = int(np.abs(off).max(initial=0))
    if most * most * max(1, off.shape[1]) < 1 << 63:
        return (off * off).sum(axis=1).tolist()
    wide = off.astype(object)
    return [v if v < 1 << 63 else None for v in (wide * wide).sum(axis=1).tolist()]


def added(fit: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``part`` (a matrix of doubles) over all batches: each task adds its own, Spark adds the tasks' entries."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                total += part(batch.slice(at, ROWS_AT_ONCE))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total.reshape(-1)[cells])], names=["cell", "value"])

    out = np.zeros(shape).reshape(-1)
    for r in fit.mapInArrow(partial, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out.reshape(shape)


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and sums of their entries."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = grid(batch.column("x"), d)
            cells = np.r_[x.sum(axis=0), len(x)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1)), pa.array(cells)], names=["cell", "value"])

    rows = fit.mapInArrow(partial, "cell long, value long").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    found = {r["cell"]: int(r["value"]) for r in rows}
    return found.get(d, 0), [found.get(i, 0) for i in range(d)]


def whiten(df: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every row and component of a table with
    ``vec_id`` and ``embedding``.

    The dimension is the commonest length of a vector (the larger of equals). Rows without a vector, with null or non-finite
    entries or entries from 2^30 on, and rows of another length have no result. Repeated rows each have theirs and count once in the
    fit; a null ``vec_id`` stays null. Components are those of the ``k`` largest eigenvalues above rounding, so equal vectors
    only, one vector or an empty table give an empty result. A deviation beyond 64 bits is null; further columns are ignored.
    To the driver go sums over the table: at most one number for each two dimensions.
    """
    spark = df.sparkSession
    rows = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    common = rows.where("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("rows"))
    common = common.orderBy(F.desc("rows"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], RESULT)
    d = common["d"]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([lists(on_grid(batch.column("embedding"), d)[1])], names=["x"])

    fit = stored(rows.select("embedding").mapInArrow(vectors, "x array<long>").distinct(), "whitening-fit")
    n, sums = exact_sums(fit, d)
    if n == 0:
        return spark.createDataFrame([], RESULT)

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        return off_mean(grid(batch.column("x"), d), n, sums).astype(float) / n

    def products(batch: pa.RecordBatch) -> np.ndarray:
        y = centred(batch)
        return y.T @ y

    covariance = added(fit, products, (d, d)) / n
    covariance = (covariance + covariance.T) / 2
    values, components = largest(covariance, k)
    trace = float(np.trace(covariance))
    k = len(values)
    if k == 0:
        return spark.createDataFrame([], RESULT)
    scaled = components / np.sqrt(values)
    mean = added(fit, lambda batch: (centred(batch) @ scaled).sum(axis=0, keepdims=True), (1, k)) / n

    def spread(batch: pa.RecordBatch) -> np.ndarray:
        w = centred(batch) @ scaled - mean
        return w.T @ w

    error = float(np.abs(added(fit, spread, (k, k)) / n - np.eye(k)).max())
    explained = values / trace

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                which, x = on_grid(batch.column("embedding"), d)
                off = off_mean(x, n, sums)
                count = len(which)
                deviation = pa.array(deviations(off), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(which, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)),
                        pa.array(np.full(count * k, n)),
                        deviation.take(pa.array(np.repeat(np.arange(count), k))),
                        pa.array((off.astype(float) / n @ scaled).reshape(-1)),
                        pa.array(np.tile(explained, count)),
                        pa.array(np.full(count * k, error)),
                    ],
                    names=[part.split()[0] for part in RESULT.split(", ")],
                )

    return rows.mapInArrow(results, RESULT)
