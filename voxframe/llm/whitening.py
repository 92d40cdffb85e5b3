"""Whitening of embeddings by MLlib's singular value decomposition of the centred rows.

Entries become integers, so their sums are exact: a row's centred entry is
n * x - S, one exact integer, divided by n once. The right singular vectors of
those rows are the eigenvectors of their covariance, and a squared singular value
over n an eigenvalue. The total variance comes from the exact deviations, not from
the decomposition, which has the leading components alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, observed_stage, stage

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: floor(64 * c) is cut to this size, so that sums and products with n stay exact in longs; deviations of such entries leave longs anyway.
LIMIT = 1 << 30
#: Components whose singular value is below this part of the first are rounding noise and left out.
NOISE = 1e-7
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _usable(rows: DataFrame) -> DataFrame:
    """vec_id and the integer entries x of the rows that take part."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = F.transform("embedding", lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(c.cast("double") * SCALE))) + SHIFT)
    return rows.filter(F.col("embedding").isNotNull() & finite).select("vec_id", x.alias("x"))


def _summed(parts: DataFrame) -> list:
    """Sums by place of arrays `part`, of which there is one a batch; as many numbers as an array has reach the driver."""
    each = parts.select(F.posexplode("part").alias("at", "part"))
    return [r["part"] for r in each.groupBy("at").agg(F.sum("part").alias("part")).orderBy("at").collect()]


def sums(rows: DataFrame) -> list[int]:
    """The exact sum of each dimension."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"part": [np.stack(pdf["x"].to_numpy()).sum(axis=0, dtype=np.int64)]})

    return [int(s) for s in _summed(rows.select("x").mapInPandas(add, "part array<long>"))]


def deviations(d: np.ndarray) -> list[int]:
    """The exact sum of squares of each row of integers."""
    most = max(1, int(np.abs(d).max(initial=0)))
    if most * most * max(1, d.shape[1]) < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in d.tolist()]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row of vectors and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows with a null vector, or null or non-finite entries, take no part. Of
    vectors of unequal length those of the most frequent length count, the longer
    of such lengths in a tie. Null ids stay; rows that share an id or repeat each
    other are rows of their own. There are as many components as `components`, the
    dimensions and the rank allow: equal rows, one row, empty vectors or an empty
    table give no rows. `deviation` is null where it doesn't fit a long; the total
    variance is exact all the same. Other columns take no part.
    """
    spark = vectors.sparkSession
    rows = _usable(need(vectors, "vec_id", "embedding"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None or not lengths["d"]:
        return spark.createDataFrame([], RESULT)
    n, dim = lengths["n"], lengths["d"]
    rows = stage(rows.filter(F.size("x") == dim), "vectors")
    s = np.array(sums(rows), dtype=np.int64)
    sent = spark.sparkContext.broadcast(s)

    def centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = np.stack(pdf["x"].to_numpy()) * np.int64(n) - sent.value if len(pdf) else np.empty((0, dim), np.int64)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "deviation": [str(v) for v in deviations(d)], "centred": list(d / n)})

    made = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "x").mapInPandas(centre, "vec_id string, deviation string, centred array<double>")
    made = made.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "centred")
    centred, (total,) = observed_stage(made, "centred", F.sum("deviation"))
    if not total:
        return spark.createDataFrame([], RESULT)

    # A batch of rows at a time: the decomposition adds up their products in doubles, dim * dim of them at most in a task.
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("centred").alias("v")), "v"), n, dim)
    svd = matrix.computeSVD(min(components, dim), computeU=False, rCond=NOISE)
    value = np.array(svd.s.toArray()) ** 2 / n
    variance = int(total) / n**3
    base = np.array(svd.V.toArray()) / np.sqrt(value)
    projection = spark.sparkContext.broadcast(base)
    k = len(value)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "deviation": pdf["deviation"], "whitened": list(np.stack(pdf["centred"].to_numpy()) @ projection.value)})

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                w = np.stack(pdf["whitened"].to_numpy())
                yield pd.DataFrame({"part": [np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])]})

    as_text = centred.select(F.col("vec_id").cast("string").alias("vec_id"), F.col("deviation").cast("string").alias("deviation"), "centred")
    white = stage(as_text.mapInPandas(project, "vec_id string, deviation string, whitened array<double>"), "whitened")
    gathered = np.array(_summed(white.select("whitened").mapInPandas(products, "part array<double>")))
    mean = gathered[:k] / n
    error = float(np.abs(gathered[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = F.array(*[F.lit(float(v / variance)) for v in value])
    each = white.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error")
    )
