"""Whitening of embeddings from exact covariances.

An entry c becomes the integer x = floor(1024 c) + 100000. Vectors are moved by whole numbers near their means and split into
small limbs; products of limbs over a block of rows are so small that BLAS sums them in float64 without rounding. The limb
products are put together as big integers, added over blocks and, by Spark, over partitions. So sums and covariances are exact
whatever their order, and rounded once, before the covariance is eigendecomposed on the driver, which gets as many numbers as
the vector has dimensions, squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import measured

LIMB = 20  # bits: products over BLOCK rows stay below 2 ** 53
BLOCK = 8192
SCALE, SHIFT = 1024, 100_000
SAFE = 1 << 61


def whole(batch: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 as longs; what is out of their range becomes the nearest long."""
    x = np.floor(SCALE * batch)
    far = np.abs(x) >= 2.0**62
    out = np.where(far, 0, x).astype(np.int64) + SHIFT
    out[far] = [min(max(int(v) + SHIFT if np.isfinite(v) else (1 << 64) * int(np.sign(v)), -(1 << 63)), (1 << 63) - 1) for v in x[far]]
    return out


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y = sum of limb[k] * 2 ** (LIMB * k) as float64; all but the last are from 0 to 2 ** LIMB - 1, the last is of the same size, signed."""
    out = []
    while True:
        if not len(y) or max(abs(int(y.max())), abs(int(y.min()))) < 1 << LIMB:
            return [*out, y.astype(np.float64)]
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB


def gram(y: np.ndarray) -> np.ndarray:
    """The exact products of all columns of y, as big integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), BLOCK):
        parts = limbs(y[at : at + BLOCK])
        for a, left in enumerate(parts):
            for b, right in enumerate(parts[: a + 1]):
                product = (left.T @ right).astype(np.int64).astype(object)
                total += (product if a == b else product + product.T) << (LIMB * (a + b)) if a or b else product
    return total


def minus(x: np.ndarray, times: int, taken: list[int]) -> np.ndarray:
    """times * x - taken, exact: longs where they suffice."""
    far = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if times * far < SAFE and max(map(abs, taken), default=0) < SAFE:
        return x * times - np.array(taken, np.int64)
    return x.astype(object) * times - np.array(taken, object)


def vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: vectors without null or non-finite entries, with their number of dimensions."""
    rows = rows.select(rows[id_col].cast("long").alias("vec_id"), rows[vector_col].cast("array<double>").alias("v"))
    return rows.where("v IS NOT NULL AND NOT exists(v, c -> c IS NULL OR isnan(c) OR abs(c) = double('infinity'))").withColumn("d", F.size("v"))


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d))


def _merged(partial: DataFrame) -> DataFrame:
    """(key, values: whole numbers as text) -> the sums of each key; a task holds the sums of its own keys."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, values in zip(batch.column("key").to_pylist(), batch.column("values").to_pylist(), strict=True):
                values = np.array([int(v) for v in values], object)
                sums[key] = sums[key] + values if key in sums else values
        yield _partials(sums)

    return partial.repartition("key").mapInArrow(add, "key long, values array<string>")


def _partials(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([[str(v) for v in values] for values in sums.values()], pa.list_(pa.string()))], ["key", "values"])


def sums(data: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """d -> (rows, sums of x) of the vectors of each length."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for d in np.unique(lengths).tolist():
                x = _matrix(batch.column("v").filter(pa.array(lengths == d)), d) if d else np.zeros((int((lengths == 0).sum()), 0), np.int64)
                low, high = (x & ((1 << 32) - 1)).sum(0), (x >> 32).sum(0)  # exact for as many rows as a batch can have
                part = np.array([len(x), *(int(h) * (1 << 32) + int(v) for h, v in zip(high, low, strict=True))], object)
                found[d] = found[d] + part if d in found else part
        yield _partials(found)

    got = _merged(data.select("v", "d").mapInArrow(read, "key long, values array<string>")).collect()  # a row for each length there is
    return {r["key"]: (int(r["values"][0]), [int(v) for v in r["values"][1:]]) for r in got}


def covariance(data: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The covariance (divisor n) of x, each entry exact but for its rounding to a double."""
    d, centre = len(total), [t // n for t in total]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((d, d), object)
        for batch in batches:
            found = found + gram(minus(_matrix(batch.column("v"), d), 1, centre))
        yield _partials(dict(enumerate(found)))

    rows = {r["key"]: [int(v) for v in r["values"]] for r in _merged(data.select("v").mapInArrow(read, "key long, values array<string>")).collect()}  # d rows of d
    rest = [t - n * c for t, c in zip(total, centre, strict=True)]  # sums of the moved vectors
    return np.array([[(n * rows[i][j] - rest[i] * rest[j]) / n**2 for j in range(d)] for i in range(d)])  # / of whole numbers rounds once


def whiten(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact: the leading components of each vector, scaled to variance one.

    Vectors that are null or hold null, NaN or infinite entries drop out, as do those of another length than most have (of lengths
    that are as frequent, the longest). Components are numbered from 1 by falling variance and end where the variance is none but for rounding,
    so equal vectors or a single one give no rows. `deviation` is null where the exact sum isn't a long; `deviation_exact` has its digits.
    identity_error is the largest absolute entry of the covariance of `whitened` minus the identity.
    Null ids and repeated rows are rows like any other. An empty table gives no rows.
    """
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"
    data = vectors(rows, id_col, vector_col)
    by_length = sums(data)
    d = max(by_length, key=lambda k: (by_length[k][0], k), default=0)
    if not d:
        return spark.createDataFrame([], schema)
    n, total = by_length[d]
    data = data.where(F.col("d") == d)
    v = covariance(data, n, total)
    values, axes = np.linalg.eigh(v)
    trace = float(np.trace(v))
    order = [k for k in np.argsort(-values)[:components] if values[k] > d * np.finfo(float).eps * max(abs(values))]
    if not order:
        return spark.createDataFrame([], schema)
    axes, values = axes[:, order], values[order]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = minus(_matrix(batch.column("v"), d), n, total)
            largest = max(abs(int(far.max())), abs(int(far.min()))) if far.size else 0
            wide = far if d * largest**2 < SAFE else far.astype(object)
            deviation = [int(s) for s in (wide * wide).sum(1)]
            scores = (far.astype(np.float64) / n) @ axes / np.sqrt(values)
            columns = [batch.column("vec_id"), pa.array([s if s < 1 << 63 else None for s in deviation], pa.int64()), pa.array([str(s) for s in deviation]), pa.ListArray.from_arrays(np.arange(0, scores.size + 1, scores.shape[1], dtype=np.int32), scores.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "deviation_exact", "whitened"])

    k = len(order)
    means = {f"m{i}": F.avg(F.col("whitened")[i]) for i in range(k)}
    done, mean = measured(data.select("vec_id", "v").mapInArrow(project, "vec_id long, deviation long, deviation_exact string, whitened array<double>"), **means)
    centred = [F.col("whitened")[i] - F.lit(mean[f"m{i}"]) for i in range(k)]
    spread = done.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
    error = max(abs(spread[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i + 1))
    share = F.array(*[F.lit(float(x) / trace) for x in values])
    each = done.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("whitened").alias("nth", "whitened"), "deviation_exact")
    return each.select("vec_id", (F.col("nth") + 1).cast("int").alias("component"), "n", "deviation", "whitened", share[F.col("nth")].alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact")
