"""Whitening of embeddings by a covariance over distinct vectors, each weighted by its multiplicity or by one.

Entries become whole numbers on a grid, so sums are exact and equal vectors are equal. Equal vectors are merged; the fit
reads each distinct vector once with its weight: tasks add up centred products (a weighted matrix product a batch), only
matrices of dimensions x dimensions leave them. Each distinct vector is whitened once and joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, prepare, written
from .skew import lookup

GRID = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Eigenvalues below this share of the largest stand for directions without spread: nothing is whitened along them.
NO_SPREAD = 1e-12
#: Entries of a larger size don't fit the grid's long and count as non-finite.
LARGEST = 2.0**62


def on_grid(column: pa.Array) -> list[np.ndarray | None]:
    """Grid vectors of an array column: floor(GRID * c) + SHIFT; None for a null vector or one with null or non-finite entries."""
    found = []
    for vector in column:
        values = vector.values
        if values is None or values.null_count:
            found.append(None)
            continue
        scaled = GRID * values.to_numpy(zero_copy_only=False).astype(np.float64)
        found.append(np.floor(scaled).astype(np.int64) + SHIFT if np.all(np.abs(scaled) < LARGEST) else None)
    return found


def _gridded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(i, x) for i, x in enumerate(on_grid(batch.column(1))) if x is not None and len(x)]
        data = [x.astype("<i8").tobytes() for _, x in pairs]
        yield pa.RecordBatch.from_pydict({
            "vec_id": batch.column(0).take(pa.array([i for i, _ in pairs], pa.int64())), "dims": pa.array([len(x) for _, x in pairs], pa.int32()),
            "same": pa.array([xxhash.xxh3_128_digest(d) for d in data], pa.binary()), "x": pa.array(data, pa.binary())})


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact weighted sums of a task, as whole numbers of any size."""
    sums = None
    for batch in batches:
        if batch.num_rows:
            x, w = _matrix(batch.column(0)), batch.column(1).to_numpy()
            high, low = x >> 31, x & 0x7FFFFFFF
            if int(w.sum()) < 1 << 31 and int(np.abs(high).max()) * int(w.sum()) < 1 << 62:
                part = [(h << 31) + l for h, l in zip((w @ high).tolist(), (w @ low).tolist(), strict=True)]
            else:
                part = list(w.astype(object) @ x.astype(object))
            sums = part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
    if sums is not None:
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(sums)), pa.int32()), "total": pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))})


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, bool]:
    """n * x - sums, exact; and whether it fits 64-bit numbers (else as Python integers)."""
    bound = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if bound < 1 << 61:
        return n * x - np.array(sums, np.int64), True
    return n * x.astype(object) - np.array(sums, object), False


def _deviations(distance: np.ndarray, fits: bool) -> list[int]:
    """Exact sum of squares of each row."""
    if fits and distance.shape[1] * (int(np.abs(distance).max(initial=0)) + 1) ** 2 < 1 << 63:
        return (distance * distance).sum(1).tolist()
    exact = distance.astype(object)
    return list((exact * exact).sum(1))


def _products(n: int, sums: list[int]):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sums), len(sums)))
        for batch in batches:
            if batch.num_rows:
                c = centred(_matrix(batch.column(0)), n, sums)[0].astype(np.float64) / n
                total += (c * batch.column(1).to_numpy()[:, None]).T @ c
        yield _matrix_rows(total)

    return found


def _matrix_rows(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "i": pa.array(np.repeat(np.arange(len(total)), len(total)), pa.int32()), "j": pa.array(np.tile(np.arange(len(total)), len(total)), pa.int32()),
        "total": pa.array(total.ravel(), pa.float64())})


def _collected(rows: DataFrame, d: int) -> np.ndarray:
    """The sum of the tasks' matrices: d * d numbers, whatever the number of vectors."""
    matrix = np.zeros((d, d))
    for r in rows.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        matrix[r["i"], r["j"]] = r["total"]
    return matrix


def components_of(covariance: np.ndarray, limit: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The first eigenvalues, falling, and their unit eigenvectors as columns; each vector's largest entry is positive."""
    if not covariance.size:
        return np.zeros(0), covariance
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:limit], vectors[:, ::-1][:, :limit]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values, vectors * signs


def _whitened(n: int, sums: list[int], scaled: np.ndarray):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            distance, fits = centred(_matrix(batch.column(1)), n, sums)
            values = (distance.astype(np.float64) / n) @ scaled
            deviation = pa.array([Decimal(int(v)) for v in _deviations(distance, fits)], pa.decimal128(38, 0))
            whitened = pa.array([[None if np.isnan(v) else v for v in row] for row in values.tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict({"same": batch.column(0), "w": batch.column(2), "n": batch.column(3), "deviation": deviation, "whitened": whitened})

    return found


def _second_moments(k: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, weight = np.zeros((k, k)), np.zeros(k), 0.0
        for batch in batches:
            if batch.num_rows:
                values, w = np.array(batch.column(0).to_pylist(), np.float64), batch.column(1).to_numpy().astype(np.float64)
                total, sums, weight = total + (values * w[:, None]).T @ values, sums + w @ values, weight + w.sum()
        # the last row and column hold the sums and the weight, for the centring
        yield _matrix_rows(np.block([[total, sums[:, None]], [sums[None, :], np.array([[weight]])]]))

    return found


def whiten(vectors: DataFrame, limit: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    `weights`: "one" fits each distinct grid vector once, "counts" as often as it occurs; n is the sum of the weights. deviation is
    exact (decimal(38,0)): the sum over dimensions of (n * x - S)^2 with the weighted sums S.

    Vectors that are null or hold null, non-finite or oversized entries are dropped, empty ones too, and those of another length than
    most vectors have (of two equally frequent lengths the larger counts). Along components without spread (as all are with one
    distinct vector) whitened is null and identity_error doesn't count them; explained is 0 without any spread. A null or repeated
    vec_id gives a row like others. An empty table gives no rows; other columns are not read.
    """
    prepare(vectors.sparkSession)
    kind = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    gridded = written(kind.mapInArrow(_gridded, "vec_id long, dims int, same binary, x binary"), "whiten-grid")
    length = gridded.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    rows = gridded.filter(F.col("dims") == (length["dims"] if length else 0))
    d = length["dims"] if length else 0
    held = rows.groupBy("same").agg(F.first("x").alias("x"), F.count("*").alias("n"))
    distinct = written(held.withColumn("w", F.lit(1).cast("long") if weights == "one" else F.col("n")), "whiten-distinct")

    n = distinct.agg(F.sum("w")).first()[0] or 0
    added = distinct.select("x", "w").mapInArrow(_sums, "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total"))
    sums = [int(r["total"]) for r in added.orderBy("place").collect()]  # d numbers
    covariance = _collected(distinct.select("x", "w").mapInArrow(_products(n, sums), "i int, j int, total double"), d) / max(n, 1)
    trace = float(np.trace(covariance))
    values, axes = components_of(covariance, limit)
    spread = values > NO_SPREAD * max(values[0], 0.0) if len(values) else values > 0
    scaled = axes / np.sqrt(np.where(spread, values, np.nan))

    done = written(distinct.select("same", "x", "w", "n").mapInArrow(
        _whitened(n, sums, scaled), "same binary, w long, n long, deviation decimal(38,0), whitened array<double>"), "whitened")
    k = int(spread.sum())  # falling order: components with spread come first
    moments = _collected(done.select(F.slice("whitened", 1, max(k, 1)).alias("v"), "w").mapInArrow(_second_moments(k), "i int, j int, total double"), k + 1)
    mean = moments[:k, k] / max(n, 1)
    error = float(np.abs(moments[:k, :k] / max(n, 1) - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))

    shares = F.array(*(F.lit(float(max(v, 0.0) / trace) if trace > 0 else 0.0) for v in values)) if len(values) else F.array().cast("array<double>")
    back = lookup(rows.select("vec_id", "same"), done, ["same"])
    return back.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
