"""Whitening of embeddings: singular vectors of the centred rows, singular values rescaled by the number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import staged_and_seen, unstage

#: Singular values below this share of the largest are taken for zero: such directions have no variance that doubles could tell.
LEAST_SHARE = 1e-6
#: Exact sums stay in longs below this.
SAFE = 1 << 62


def _usable(v: Column) -> Column:
    return v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _summed(rows: DataFrame, column: str, width: int, kind: str, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all rows of what part makes of a batch's matrix, `width` numbers: one row a task and number leaves the tasks, width rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                new = part(_matrix(batch.column(0))).ravel()
                total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["place", "total"])

    found = rows.select(column).mapInArrow(run, f"place int, total {kind}").groupBy("place").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(width, np.int64 if kind == "long" else np.float64)
    for r in found:
        out[r.place] = r.total
    return out


def _squares(dx: np.ndarray, n: int, rest: np.ndarray) -> list[int]:
    """Sum over the dimensions of (n * dx - rest) ** 2 for each row, exact."""
    reach = (int(np.abs(dx).max(initial=0)) + 1) * n
    if reach * reach * max(dx.shape[1], 1) < SAFE:
        v = dx * n - rest
        return (v * v).sum(axis=1).tolist()
    return [sum((int(a) * n - int(b)) ** 2 for a, b in zip(row, rest)) for row in dx]


def whiten(rows: DataFrame, components: int = 32, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and each of the first components.

    Entries c become x = floor(scale * c) + offset, as longs. Rows are centred by the exact mean (whole part first, then the fraction, so
    nothing is lost to the offset) and go to MLlib's computeSVD; a component is a right singular vector, numbered from 1 by falling singular value s, and its eigenvalue is
    e = s ** 2 / n. deviation is the sum of (n * x - S) ** 2 over the dimensions, S being a dimension's sum: exact, as a long, null where a long
    cannot hold it; total variance is the sum of all deviations over n ** 3, apart from the decomposition. whitened is the centred row on the component over sqrt(e),
    explained is e over the total variance, identity_error the largest absolute entry of whitened's covariance (divisor n, centred) minus the identity.

    Null vectors and those with null or non-finite entries are left out of fit and result. Shorter vectors count as if filled up with zeros. Null ids, repeated ids and rows are
    rows like others. Directions without variance are no components, so a table of equal vectors, like an empty one, gives no rows. Entries too large for a long end the job. Other columns are ignored.
    The driver gets one number for each dimension and pair of components; MLlib adds up the products of the dimensions in a tree over the executors.
    """
    spark = rows.sparkSession
    v = F.col(f"`{embedding}`").cast("array<double>")
    base = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), v.alias("v")).where(_usable(F.col("v")))
    base = base.select("vec_id", F.transform("v", lambda c: F.floor(c * scale) + offset).alias("x"))
    base, seen = staged_and_seen(base, "whitening-rows", n=F.count("*"), dim=F.max(F.size("x")))
    n, dim = seen["n"], seen["dim"] or 0
    kind = dict(rows.dtypes)[vec_id]
    nothing = spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not n or not dim:
        return nothing
    even = base.withColumn("x", F.concat("x", F.array_repeat(F.lit(offset).cast("long"), F.lit(dim) - F.size("x"))))
    sums = _summed(even, "x", dim, "long", lambda m: m.sum(axis=0))
    whole, rest = sums // n, sums % n
    share = rest / n
    centred = F.zip_with(F.zip_with("x", F.lit(whole.tolist()), lambda a, b: (a - b).cast("double")), F.lit(share.tolist()), lambda a, b: a - b)
    vectors = MLUtils.convertVectorColumnsFromML(even.select(array_to_vector(centred).alias("v")), "v")
    svd = RowMatrix(vectors, n, dim).computeSVD(min(components, dim), computeU=False, rCond=LEAST_SHARE)
    s = np.asarray(svd.s.toArray())
    k = int((s > 0).sum())
    if not k:
        unstage(base)
        return nothing
    variances, axes = s[:k] ** 2 / n, svd.V.toArray()[:, :k]
    to = axes / np.sqrt(variances)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dx = _matrix(batch.column("x")) - whole
                w = (dx - share) @ to
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([Decimal(d) for d in _squares(dx, n, rest)], pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "w"])

    done = even.mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), w array<double>")
    done, seen = staged_and_seen(done, "whitening-projected", total=F.sum("deviation"))
    unstage(base)
    total = float(Fraction(int(seen["total"]), n**3))
    mean = _summed(done, "w", k, "double", lambda m: m.sum(axis=0)) / n
    covariance = _summed(done, "w", k * k, "double", lambda m: (m - mean).T @ (m - mean)).reshape(k, k) / n
    error = float(np.abs(covariance - np.eye(k)).max())
    explained = F.element_at(F.lit((variances / total).tolist()), F.col("component"))
    out = done.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("w").alias("place", "whitened"))
    return out.withColumn("component", F.col("place") + 1).select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
