"""Calibration of a stationary residual's lags: which raw coefficients give wanted correlations after a high-pass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.linear import solve

# The Gaussian of the high-pass, the grid of frequencies, and the bounds of wanted and raw coefficients and of their sum.
SIGMA, TRUNCATE, GRID = 0.6, 4.0, 64
WANTED, RAW, BOUND = 0.45, 0.24, 0.95
#: The lags: one voxel along each axis, then two.
LAGS = tuple((axis, lag) for lag in (1, 2) for axis in range(3))


def response(f: Column, sigma: float = SIGMA, truncate: float = TRUNCATE) -> Column:
    """What a Gaussian cut at `truncate` sigma passes of a frequency in cycles a voxel."""
    radius = int(truncate * sigma + 0.5)
    taps = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    return sum((F.cos(2 * math.pi * d * f) * (t / math.fsum(taps)) for d, t in zip(range(-radius, radius + 1), taps, strict=True)), F.lit(0.0))


def moments(spark: SparkSession, grid: int = GRID, sigma: float = SIGMA) -> DataFrame:
    """One row, gathered over the grid^3 frequencies: variance, and for the lags lag0, variance_basis (one number each) and lag_basis (6 x 6)."""
    at = lambda n: F.when(2 * n < grid, n).otherwise(n - grid) / float(grid)
    rows = spark.range(grid**3).select(*[at(F.floor(F.col("id") / grid**k) % grid).alias(f"f{k}") for k in range(3)])
    passed = 1 - response(F.col("f0"), sigma) * response(F.col("f1"), sigma) * response(F.col("f2"), sigma)
    cos = [F.cos(2 * math.pi * lag * F.col(f"f{axis}")) for axis, lag in LAGS]
    rows = rows.select((passed * passed).alias("w"), *[c.alias(f"c{k}") for k, c in enumerate(cos)])
    mean = lambda c: F.avg(F.col("w") * c)
    c = [F.col(f"c{k}") for k in range(6)]
    return rows.agg(
        F.avg("w").alias("variance"), F.array(*[mean(x) for x in c]).alias("lag0"), F.array(*[mean(2 * x) for x in c]).alias("variance_basis"),
        F.array(*[F.array(*[mean(2 * x * y) for y in c]) for x in c]).alias("lag_basis"),
    )


def calibrated(cases: DataFrame, wanted: str = "lags", grid: int = GRID, sigma: float = SIGMA) -> DataFrame:
    """Adds raw and achieved, six numbers each, and residual, the largest error of the equations before any bound.

    `wanted` holds the correlations asked for at one voxel along each axis, then
    at two. They are cut to WANTED, raw coefficients to RAW, and shrunk together
    where twice their sum exceeds BOUND, which keeps the spectrum positive. A
    singular system gives zeros, the white residual. Null or missing lags give nulls.
    The moments, 49 numbers, are gathered once and become part of the plan.
    """
    found = moments(cases.sparkSession, grid, sigma).first()
    numbers = lambda a: F.array(*map(F.lit, a))
    known = {"variance": F.lit(found["variance"]), "lag0": numbers(found["lag0"]), "variance_basis": numbers(found["variance_basis"]), "lag_basis": F.array(*map(numbers, found["lag_basis"]))}
    rows = cases.withColumns({f"_{k}": v for k, v in known.items()}).withColumn("_wanted", F.when(F.size(wanted) == 6, F.transform(wanted, lambda x: F.least(F.greatest(x, F.lit(-WANTED)), F.lit(WANTED)))))
    places = F.array(*map(F.lit, range(6)))

    def row(k: Column) -> Column:
        """An equation: what each coefficient adds to the lag, less the wanted share of what it adds to the variance."""
        d = F.get("_wanted", k)
        own = F.zip_with(F.get("_lag_basis", k), "_variance_basis", lambda b, v: b - d * v)
        return F.concat(own, F.array(d * F.col("_variance") - F.get("_lag0", k)))

    rows = rows.withColumn("_system", F.transform(places, row)).withColumn("_solved", solve(F.col("_system")))
    error = lambda eq, x: F.abs(A.total(F.zip_with(F.slice(eq, 1, 6), x, lambda a, b: a * b)) - F.get(eq, 6))
    rows = rows.withColumn("residual", F.when(F.col("_wanted").isNotNull(), F.coalesce(F.array_max(F.transform("_system", lambda eq: error(eq, F.col("_solved")))), F.lit(0.0))))
    cut = F.transform(F.coalesce("_solved", F.array_repeat(F.lit(0.0), 6)), lambda x: F.least(F.greatest(x, F.lit(-RAW)), F.lit(RAW)))
    shrunk = A.let(lambda r: A.let(lambda s: F.transform(r, lambda x: F.when(s > BOUND, x * BOUND / s).otherwise(x)), 2 * A.total(F.transform(r, F.abs))), cut)
    rows = rows.withColumn("raw", F.when(F.col("_wanted").isNotNull(), shrunk))
    dot = lambda a: A.total(F.zip_with(a, "raw", lambda x, y: x * y))
    reached = F.transform(places, lambda k: (F.get("_lag0", k) + dot(F.get("_lag_basis", k))) / F.greatest(F.col("_variance") + dot(F.col("_variance_basis")), F.lit(1e-8)))
    done = rows.withColumn("achieved", F.when(F.col("_wanted").isNotNull(), reached))
    return done.select(*cases.columns, "raw", "achieved", "residual")
