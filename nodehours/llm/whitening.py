"""Whitening of embeddings along the leading components of their covariance."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodehours.llm.common import Folder
from nodehours.llm.eigen import leading

MOST = 1 << 52  # grid steps from zero at which entries stop
RANK = 1e-12  # share of the largest eigenvalue below which a component counts as absent
SAFE = float(1 << 62)


def _list(flat: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


def _gridded(scale: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id and x of the rows whose vector has finite entries only."""
        for b in batches:
            vectors = b["vector"].filter(b["vector"].is_valid())
            ids = b["id"].filter(b["vector"].is_valid())
            at = np.asarray(vectors.offsets).astype(np.int64)
            values = vectors.values.slice(at[0], at[-1] - at[0])
            at -= at[0]
            good = np.asarray(values.is_valid()) if values.null_count else np.ones(len(values), bool)
            c = np.asarray(values.fill_null(0)).astype(np.float64)
            good &= np.isfinite(c)
            bad = np.concatenate([[0], np.cumsum(~good)])
            keep = bad[at[1:]] == bad[at[:-1]]
            x = np.clip(np.floor(scale * np.where(good, c, 0.0)), -MOST, MOST).astype(np.int64) + shift
            inside = np.repeat(keep, np.diff(at))
            offsets = np.concatenate([[0], np.cumsum(np.diff(at)[keep])])
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(keep)), _list(x[inside], offsets)], ["id", "x"])

    return run


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    x = b["x"]
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(x), -1) if len(x) else np.zeros((0, 0), np.int64)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of their dimensions; halves of the numbers are summed apart."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b)
            high = (x >> 32).sum(0)
            yield pa.record_batch({"i": pa.array(np.arange(len(high)), pa.int64()), "n": pa.array([len(x)] * len(high), pa.int64()),
                                   "high": pa.array(high, pa.int64()), "low": pa.array((x & 0xFFFFFFFF).sum(0), pa.int64())})

    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    got = fit.mapInArrow(add, "i long, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), big("high"), big("low")).collect()
    got = sorted((r.i, r.n, (int(r.high) << 32) + int(r.low)) for r in got)  # a row for each dimension
    return (got[0][1] if got else 0), [s for _, _, s in got]


def _moments(fit: DataFrame, of, k: int) -> np.ndarray:
    """Mean of y y' over the fit list for the k numbers y that a function gives for each vector; sums of shards are added."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                y = of(_matrix(b))
                total += y.T @ y
        i, j = np.triu_indices(k)
        yield pa.record_batch({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "s": pa.array(total[i, j])})

    out = np.zeros((k, k))
    for r in fit.mapInArrow(add, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # k * k rows
        out[r.i, r.j] = out[r.j, r.i] = r.s
    return out


def centred(n: int, sums: list[int]):
    """x - S/n in double, the whole part of the mean subtracted in whole numbers first."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])
    return lambda x: (x - whole) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over the dimensions of (n x - S)^2, exact; whole numbers of any size where 64 bits do not do."""
    far = max([float(np.abs(x).max(initial=0)) * n, *[abs(float(s)) for s in sums]])
    if far < SAFE / 2:
        y = x * n - np.array(sums, np.int64)
        if (y.astype(np.float64) ** 2).sum(1).max(initial=0) < SAFE:
            return pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(1) if len(x) else []
    return pa.array([Decimal(int(v)) if v < 10 ** 38 else None for v in exact], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = 16, scale: int = 64,
           shift: int = 1_000_000) -> DataFrame:
    """Embeddings projected on the leading components of their covariance, each scaled to variance one.

    Rows whose vector is null or holds null or non-finite entries are dropped. An entry c becomes x = floor(scale * c) + shift.
    Every distinct x vector once is the fit list: n vectors with sums S. Their covariance (divisor n) is added up from centred
    vectors shard by shard; its leading eigenvectors (see eigen) are found once and broadcast. For every row that
    remains and every component from 1: vec_id, component, n, deviation (sum of (n x - S)^2, exact, null from 10^38 on), whitened
    (centred x on the component, over the root of its eigenvalue), explained (eigenvalue over trace), identity_error (largest
    entry of the fit list's whitened covariance less the identity).

    Repeated rows come back each but count once. Components whose variance vanishes are not given, so a table of equal vectors
    or an empty one has no rows. A vector shorter than the longest counts as ending in zeros; scaled entries
    stop at 2^52. The driver and each task hold matrices of dimensions squared. Other columns are ignored.
    """
    spark = vectors.sparkSession
    folder = Folder(spark, "whiten")
    kind = dict(vectors.dtypes)[vec_id]
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
    rows = folder.put(rows.mapInArrow(_gridded(scale, shift), f"id {kind}, x array<long>"), "rows")
    shortest, width = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if shortest != width:
        rows = folder.put(rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(width) - F.size("x")))), "full")
    out = f"{vec_id} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fit = folder.put(rows.select("x").distinct(), "fit")
    n, sums = _sums(fit) if width else (0, [])
    if not n:
        return spark.createDataFrame([], out)
    centre = centred(n, sums)
    covariance = _moments(fit, centre, width) / n
    trace = float(np.trace(covariance))
    values, axes = leading(covariance, min(components, width))
    real = values > RANK * max(values.max(initial=0), 0)
    values, axes = values[real], axes[real]
    if not len(values):
        return spark.createDataFrame([], out)
    shared = spark.sparkContext.broadcast((axes / np.sqrt(values)[:, None]).T)
    k = len(values)
    error = float(np.abs(_moments(fit, lambda x: centre(x) @ shared.value, k) / n - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b)
            if len(x):
                at = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    b["id"].take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)),
                    deviations(x, n, sums).take(at), pa.array((centre(x) @ shared.value).ravel()),
                    pa.array(np.tile(values / trace, len(x))), pa.array(np.full(len(x) * k, error))],
                    [vec_id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, out)
