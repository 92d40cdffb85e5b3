"""How far a volume may go towards a style: structure gates, and a search that halves the step until they hold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .registry import ColumnVolume

# The gates, the least step, the high-pass of the correlation, and what counts as nothing.
LEAST_ALIGNMENT, LEAST_CORRELATION, MOST_NEW_ZEROS = 0.96, 0.94, 1e-4
LEAST_STEP = 1 / 128
HIGHPASS_SIGMA = 0.8
NONE = 1e-8


def _volume(voxels: Column, shape: Column) -> ColumnVolume:
    return ColumnVolume(voxels, voxels, shape, F.lit(""), 0, "")


def smoothed(voxels: Column, shape: Column, sigma: float) -> Column:
    """A Gaussian cut at four sigma, an axis at a time, mirrored at the faces with the face repeated."""
    radius = int(4 * sigma + 0.5)
    taps = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]

    def along(values: Column, axis: int) -> Column:
        def run(x: Column) -> Column:
            v = _volume(x, shape)
            n = v.size(axis)

            def one(_: Column, *place: Column) -> Column:
                out = F.lit(0.0)
                for d, t in zip(range(-radius, radius + 1), taps, strict=True):
                    p, spot = F.pmod(place[axis] + d, 2 * n), list(place)
                    spot[axis] = F.when(p < n, p).otherwise(2 * n - 1 - p)
                    out = out + t / math.fsum(taps) * v.at(*spot)
                return out

            return v.map(one)

        return A.let(run, values)

    return along(along(along(voxels, 0), 1), 2)


def gradients(voxels: Column, shape: Column) -> Column:
    """Of each voxel the differences along the axes: central, one-sided at the faces, 0 along an axis of one voxel."""

    def run(x: Column) -> Column:
        v = _volume(x, shape)

        def one(_: Column, *place: Column) -> Column:
            out = []
            for axis in range(3):
                n = v.size(axis)
                low, high = list(place), list(place)
                low[axis], high[axis] = F.greatest(place[axis] - 1, F.lit(0)), F.least(place[axis] + 1, n - 1)
                out.append(F.when(n > 1, (v.at(*high) - v.at(*low)) / (high[axis] - low[axis])).otherwise(0.0))
            return F.array(*out)

        return v.map(one)

    return A.let(run, voxels)


def _length(g: Column) -> Column:
    return F.sqrt(A.total(F.transform(g, lambda d: d * d)))


def alignment(source: Column, trial: Column) -> Column:
    """Mean cosine between two fields of gradients, weighted by how far the source's lengths exceed their 60th percentile; by the
    lengths where none does. A source without gradients is aligned only with a trial without."""

    def run(a: Column, b: Column, length: Column) -> Column:
        cosine = F.zip_with(F.zip_with(a, b, lambda g, h: F.struct(A.total(F.zip_with(g, h, lambda x, y: x * y)).alias("dot"), _length(h).alias("n"))), length, lambda p, m: p["dot"] / F.greatest(m * p["n"], F.lit(1e-10)))

        def weighed(w: Column, c: Column) -> Column:
            return A.total(F.zip_with(w, c, lambda x, y: x * y)) / F.greatest(A.total(w), F.lit(NONE))

        over = A.let(lambda q: F.transform(length, lambda m: F.greatest(m - q, F.lit(0.0))), A.percentile(length, 60.0))
        still = F.when(F.array_max(F.transform(b, _length)) <= NONE, 1.0).otherwise(0.0)
        return F.when(F.array_max(length) <= NONE, still).otherwise(A.let(weighed, A.let(lambda o: F.when(A.total(o) > NONE, o).otherwise(length), over), cosine))

    return A.let(lambda a, b: A.let(lambda n: run(a, b, n), F.transform(a, _length)), source, trial)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's, of arrays; where one is flat, 1 if the second is, else 0."""

    def run(x: Column, y: Column) -> Column:
        sums = [A.total(F.zip_with(p, q, lambda s, t: s * t)) for p, q in ((x, y), (x, x), (y, y))]
        return A.let(lambda xy, xx, yy: F.when(F.sqrt(xx * yy) > NONE, xy / F.sqrt(xx * yy)).otherwise(F.when(F.sqrt(yy / F.size(y)) <= NONE, 1.0).otherwise(0.0)), *sums)

    centred = lambda v: A.let(lambda w: A.let(lambda m: F.transform(w, lambda x: x - m), A.mean(w)), v)
    return A.let(run, centred(a), centred(b))


def blended(source: Column, candidate: Column, step: Column) -> Column:
    """A step of the way, within [0, 1]; exact zeros of the source stay."""
    return F.zip_with(source, candidate, lambda x, y: F.when(x == 0, x).otherwise(A.clip(x + step * (F.coalesce(F.nanvl(y, F.lit(0.0)), F.lit(0.0)) - x))))


def search(df: DataFrame, candidate: str, voxels: str = "voxels", shape: str = "shape", least_alignment: float = LEAST_ALIGNMENT, least_correlation: float = LEAST_CORRELATION) -> DataFrame:
    """`voxels` moved towards `candidate` by the first of the steps 1, 1/2, ... 1/128 that keeps the gates; as they were if none does.

    Adds step (0: none), alignment, correlation and new_zeros, the share of voxels
    that became 0. What the gates need of the source is computed once, and a row
    whose step was accepted pays for no later one. A row whose arrays are null, or
    unlike in size, stays as it is, with nulls.
    """
    steps = F.array(*[F.lit(2.0**-k) for k in range(int(-math.log2(LEAST_STEP)) + 1)])
    grid = F.col(shape)
    fields = lambda step, v, a, c, z: F.struct(step.alias("step"), v.alias("voxels"), a.alias("alignment"), c.alias("correlation"), z.alias("new_zeros"))

    def highpassed(v: Column) -> Column:
        return A.let(lambda x: F.zip_with(x, smoothed(x, grid, HIGHPASS_SIGMA), lambda p, q: p - q), v)

    def attempt(x: Column, y: Column, own: Column, high: Column, step: Column) -> Column:
        def judged(trial: Column) -> Column:
            zeros = F.size(F.filter(F.zip_with(x, trial, lambda p, q: (q == 0) & (p != 0)), lambda t: t)) / F.size(x)
            gates = A.let(lambda a, c, z: fields(step, trial, a, c, z), alignment(own, gradients(trial, grid)), correlation(high, highpassed(trial)), zeros)
            return A.let(lambda g: F.when((g["alignment"] >= least_alignment) & (g["correlation"] >= least_correlation) & (g["new_zeros"] <= MOST_NEW_ZEROS), g), gates)

        return A.let(judged, blended(x, y, step))

    def run(x: Column, y: Column, own: Column, high: Column) -> Column:
        kind = "struct<step:double,voxels:array<double>,alignment:double,correlation:double,new_zeros:double>"
        found = F.aggregate(steps, F.lit(None).cast(kind), lambda best, t: F.when(best.isNotNull(), best).otherwise(attempt(x, y, own, high, t)))
        return F.coalesce(found, fields(F.lit(0.0), x, F.lit(1.0), F.lit(1.0), F.lit(0.0)))

    whole = F.col(voxels).isNotNull() & F.col(candidate).isNotNull() & grid.isNotNull() & (F.size(voxels) == F.size(candidate))
    own = F.transform(voxels, lambda x: x.cast("double"))
    rows = df.withColumn("_source", F.when(whole, own))
    rows = rows.withColumns({"_gradients": gradients(F.col("_source"), grid), "_high": highpassed(F.col("_source"))})
    rows = rows.withColumn("_found", F.when(whole, A.let(run, F.col("_source"), F.transform(candidate, lambda x: x.cast("double")), F.col("_gradients"), F.col("_high"))))
    done = rows.withColumns({voxels: F.coalesce("_found.voxels", own), **{k: F.col(f"_found.{k}") for k in ("step", "alignment", "correlation", "new_zeros")}})
    return done.drop("_source", "_gradients", "_high", "_found")
