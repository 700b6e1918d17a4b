"""Embedding whitening by weighted multiplicity covariance.

Vectors become integers; equal ones are grouped, and each distinct one stands in the fit list once, with its number of
copies or one as weight. Sums are exact. The covariance is a weighted matrix product of the centred vectors, formed
batch by batch where the distinct vectors lie; only sums over them, as large as the dimension squared, come together.
Each distinct vector is whitened once and joined back to its copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import materialize, salted_join, spark_parts

#: Integer form of a component c: floor(SCALE * c) + OFFSET; components of the result at most.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Where components of the integer form end, so that they remain longs.
LIMIT = 2.0**60
#: Eigenvalues below this part of the trace are rounding, not variance.
LEAST = 1e-12


def integer_vector(vector: Column) -> Column:
    """The integer form as array of longs, held within LIMIT; null for a null or empty vector or one with null or
    non-finite components."""
    scaled = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.when(finite & (F.size(vector) > 0), F.transform(vector, lambda c: (F.floor(scaled(c)) + OFFSET).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def weighted_sums(fit: DataFrame, vector: str) -> tuple[int, list]:
    """Total weight and, for each dimension, the weighted sum of (``vector``, weight); exact for integers."""
    whole = fit.schema[vector].dataType.elementType.simpleString() == "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, object] = {}
        n = 0
        for batch in batches:
            x, w = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            n += int(w.sum())
            if whole and int(np.abs(x).max(initial=0)) * int(w.sum()) >= 1 << 62:
                x = x.astype(object)
            for i, s in enumerate((x * w[:, None]).sum(axis=0)):
                total[i] = total.get(i, 0) + (int(s) if whole else float(s))
        values = pa.array([str(v) for v in total.values()] if whole else list(total.values()), pa.string() if whole else pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), values, pa.array([n] * len(total), pa.int64())], names=["i", "s", "n"])

    kind = "decimal(38,0)" if whole else "double"
    parts = fit.select(vector, "weight").mapInArrow(run, f"i int, s {'string' if whole else 'double'}, n long")
    rows = parts.groupBy("i").agg(F.sum(F.col("s").cast(kind)).alias("s"), F.sum("n").alias("n")).orderBy("i").collect()  # dimension rows
    return (int(rows[0]["n"]) if rows else 0), [int(r["s"]) if whole else r["s"] for r in rows]


def centred_covariance(fit: DataFrame, vector: str, n: int, sums: list) -> np.ndarray:
    """Covariance of ``vector`` over the weights, divisor n, centred before multiplying: one matrix product a batch."""
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            y = _centred(_matrix(batch.column(0)), n, sums)
            total += (y * batch.column(1).to_numpy(zero_copy_only=False)[:, None]).T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    rows = fit.select(vector, "weight").mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    out = np.zeros((d, d))
    for i, j, v in rows.groupBy("i", "j").agg(F.sum("v")).collect():  # dimension squared rows
        out[i, j] = v / n
    return (out + out.T) / 2


def _centred(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    """x - S / n; for integers from n * x - S, which is exact, so that nothing is lost to the size of x."""
    if x.dtype != np.int64:
        return x - np.array(sums, np.float64) / n
    return _deviations(x, n, sums).astype(np.float64) / n


def _deviations(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    """n * x - S, in longs where they suffice for it, else in integers of any size."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    return x * np.int64(n) - np.array(sums, np.int64) if most < 1 << 61 else x.astype(object) * n - np.array(sums, object)


def eigenvectors(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues that are above rounding, falling, and their unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(most, int((values > LEAST * max(np.trace(covariance), 0.0)).sum()))
    return values[:count], vectors[:, :count]


def whitened_vectors(fit: DataFrame, n: int, sums: list, values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(x, weight, deviation, w) for each distinct vector: squared distance from the mean, times n squared, as exact
    decimal (null beyond 38 digits), and the projections on the components over the root of their eigenvalues."""
    projection = vectors / np.sqrt(values) if len(values) else vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dev = _deviations(_matrix(batch.column(0)), n, sums)
            near = dev.dtype == np.int64 and int(np.abs(dev).max(initial=0)) < (1 << 31) // max(1, int(len(sums) ** 0.5) + 1)
            square = [int(v) for v in (dev**2 if near else dev.astype(object) ** 2).sum(axis=1)]
            w = (dev.astype(np.float64) / n) @ projection
            exact = pa.array([str(v) if v < 10**38 else None for v in square], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), exact, pa.array(list(w), pa.list_(pa.float64()))], names=["x", "weight", "deviation", "w"])

    out = fit.select("x", "weight").mapInArrow(run, "x array<long>, weight long, deviation string, w array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whiten(docs: DataFrame, ident: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS, weight: str = "one") -> DataFrame:
    """ident, n, deviation (decimal), whitened (array of up to ``most`` doubles), explained (array) and identity_error for
    each row of ``docs`` whose vector counts.

    weight: "one", each distinct vector once, or "count", as often as it occurs. n is the total weight, deviation the
    sum over dimensions of (n * x - S) ** 2. explained is a component's eigenvalue over the trace, identity_error the
    largest absolute entry of the whitened vectors' covariance, measured over the fit list, minus the identity.

    Null or empty vectors and those with null or non-finite components drop out, and vectors of another length than
    the most frequent one (ties: the longer). Components beyond LIMIT / SCALE count as that. Components without variance are left out; if there are none, as for a
    single distinct vector, the arrays are empty and identity_error is null. Null id, rows that repeat: a result each.
    Empty table: no rows. Other columns play no part.
    """
    if weight not in ("one", "count"):
        raise ValueError(f"weight is one or count, not {weight}")
    rows = docs.select(F.col(ident).alias("id"), integer_vector(F.col(vector)).alias("x")).where("x is not null")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.where(F.size("x") == (lengths["d"] if lengths else 0))
    counted = rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    fit = materialize(counted.select("x", (F.col("copies") if weight == "count" else F.lit(1)).cast("long").alias("weight")), "white-fit")
    n, sums = weighted_sums(fit, "x")
    covariance = centred_covariance(fit, "x", n, sums) if n else np.zeros((0, 0))
    values, vectors = eigenvectors(covariance, most) if n else (np.zeros(0), np.zeros((0, 0)))
    white = materialize(whitened_vectors(fit, n, sums, values, vectors), "white-vectors")
    error = None
    if len(values):
        error = float(np.abs(centred_covariance(white, "w", n, weighted_sums(white, "w")[1]) - np.eye(len(values))).max())
    known = white.select("x", "deviation", "w")
    out = salted_join(rows, known, ["x"], salts=max(4, spark_parts(docs) // 3), by=F.xxhash64("id"))
    explained = F.array(*(F.lit(float(v)) for v in values / max(float(np.trace(covariance)), 1e-300))).cast("array<double>")
    return out.select(F.col("id").alias(ident), F.lit(n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"), explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def whitened_rows(docs: DataFrame, ident: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """whiten() with a row for each component, numbered from 1; rows of tables without variance have none."""
    given = whiten(docs, ident, vector, most)
    each = given.select(ident, "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select(ident, (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
