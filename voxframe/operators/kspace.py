"""Motion between the lines of k-space, as a job over slices.

A slice is an array of lines with y along the phase axis and x across, in order.
Slices are dealt out by volume, slice and pose; each pose sends on only the lines
of k-space that were taken in it, and a slice is put together from these. No row
holds more than a slice until the volume is whole again. A slice's transform is
NumPy's, in Arrow batches: the one of functions.fourier gives the same, but takes
ten times as long to plan and to run.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import draws
from ..functions import fourier as T
from .registry import operator, with_pandas


def slices(volumes: DataFrame, axis: Column) -> DataFrame:
    """(_uid, case_id, shape, axis, k, ny, nx, values) from (_uid, case_id, shape, voxels): the slices of the last axis, lines along `axis`, 0 or 1."""
    n = [F.get("shape", a) for a in range(3)]
    volumes = volumes.withColumn("axis", axis)
    volumes = volumes.withColumns({"ny": F.when(F.col("axis") == 0, n[0]).otherwise(n[1]), "nx": F.when(F.col("axis") == 0, n[1]).otherwise(n[0])})

    def plane(v: Column, k: Column, size: Column) -> Column:
        def one(at: Column) -> Column:
            y, x = F.floor(at / F.col("nx")), at % F.col("nx")
            return F.get(v, (F.when(F.col("axis") == 0, y * n[1] + x).otherwise(x * n[1] + y) * n[2] + k).cast("int"))

        return F.transform(F.sequence(F.lit(0), size - 1), one)

    planes = A.let(lambda v, size: F.transform(F.sequence(F.lit(0), n[2] - 1), lambda k: plane(v, k, size)), F.col("voxels"), n[0] * n[1])
    return volumes.select("_uid", "case_id", "shape", "axis", "ny", "nx", F.posexplode(planes).alias("k", "values"))


def volumes_of(planes: DataFrame) -> DataFrame:
    """(_uid, voxels) from slices again."""
    whole = planes.groupBy("_uid").agg(*[F.first(c).alias(c) for c in ("shape", "axis", "nx")], F.array_sort(F.collect_list(F.struct("k", "values"))).alias("planes"))
    n = [F.get("shape", a) for a in range(3)]

    def voxel(p: Column, at: Column) -> Column:
        k, j, i = at % n[2], F.floor(at / n[2]) % n[1], F.floor(at / (n[1] * n[2]))
        return F.get(F.get(p, k)["values"], F.when(F.col("axis") == 0, i * F.col("nx") + j).otherwise(j * F.col("nx") + i).cast("int"))

    return whole.select("_uid", A.let(lambda p, size: F.transform(F.sequence(F.lit(0), size - 1), lambda at: voxel(p, at)), F.col("planes"), n[0] * n[1] * n[2]).alias("voxels"))


def _transformed(planes: DataFrame, of: Callable[[pd.Series], np.ndarray], transform: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """With `re` and `im` of the transform of each row's slice, a step of its own in the plan."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [transform(of(row).reshape(row["ny"], -1)).ravel() for _, row in pdf.iterrows()]
        return pdf.assign(re=[z.real for z in out], im=[z.imag for z in out])

    return with_pandas(planes, run, "re array<double>, im array<double>", changed=())


def spectra(planes: DataFrame) -> DataFrame:
    """With `z`, the complex numbers (re, im) of each slice's transform, in its own order."""
    made = _transformed(planes, lambda row: row["values"], np.fft.fft2)
    return made.withColumn("z", F.arrays_zip("re", "im")).drop("values", "re", "im")


def images(planes: DataFrame, magnitude: bool = False) -> DataFrame:
    """spectra() undone: `values`, the real parts or magnitudes cut to [0, 1]."""
    apart = planes.withColumns({"a": F.col("z.re"), "b": F.col("z.im")}).drop("z")
    made = _transformed(apart, lambda row: row["a"] + 1j * row["b"], np.fft.ifft2)
    size = F.zip_with("re", "im", F.hypot) if magnitude else F.col("re")
    return made.withColumn("values", F.transform(size, lambda x: A.clip(x))).drop("a", "b", "re", "im")


def rotated(degrees: Column) -> Column:
    """The slice `values` turned about its centre, from y towards x; linear between voxels, held to the edge outside."""
    ny, nx = F.col("ny"), F.col("nx")
    cy, cx = (ny - 1) / 2.0, (nx - 1) / 2.0

    def run(a: Column, cos: Column, sin: Column) -> Column:
        def pick(p: Column, q: Column) -> Column:
            i, j = F.floor(p).cast("int"), F.floor(q).cast("int")
            voxel = lambda di, dj: F.get(a, F.least(i + di, ny - 1) * nx + F.least(j + dj, nx - 1))
            s, t = p - i, q - j
            return (1 - s) * ((1 - t) * voxel(0, 0) + t * voxel(0, 1)) + s * ((1 - t) * voxel(1, 0) + t * voxel(1, 1))

        def one(_: Column, at: Column) -> Column:
            y, x = F.floor(at / nx) - cy, at % nx - cx
            return A.let(pick, A.clip(cos * y + sin * x + cy, 0, ny - 1.0), A.clip(-sin * y + cos * x + cx, 0, nx - 1.0))

        return F.transform(a, one)

    return A.let(run, F.col("values"), F.cos(F.radians(degrees)), F.sin(F.radians(degrees)))


def _line(ky: Column, n: Column) -> Column:
    """The place of a transform's line in k-space from one end to the other."""
    return (T.frequency(ky, n) + F.floor(n / 2)).cast("int")


@operator("motion", "kspace", "3d", (0.0, 1.0), lowering="job", pool=True, train=(0.3, 1.1), has_detector=True)
def motion(volumes: DataFrame, severity: float, seed: int, n_poses: int = 8, pe_axis: int | None = None, magnitude: bool = False) -> DataFrame:
    """Bands of phase-encoding lines come from the head in other poses, one schedule for the whole volume.

    In 40 % the central band comes from one nearly clean pose. The phase axis is
    drawn from the first two unless it is given.
    """
    if n_poses < 1:
        raise ValueError("motion needs a pose")
    drawn = lambda *d: draws.uniform(F.lit(seed), F.col("case_id"), "motion", *d)
    planes = slices(volumes, F.lit(pe_axis) if pe_axis is not None else F.when(drawn("axis") < 0.5, 0).otherwise(1))
    n, other = F.col("ny"), F.col("nx")
    count = F.least(F.lit(n_poses), n)
    centric = drawn("centric") < 0.4

    # The pose of each line: its band's, or that of the central band, which has the number n_poses.
    half, band = F.floor(n / 2), F.greatest(F.floor(0.12 * n), F.lit(1))

    def pose_of(ky: Column) -> Column:
        line = _line(ky, n)
        of = F.array_max(F.filter(F.sequence(F.lit(0), count - 1), lambda i: F.floor(i * n / count) <= line))
        return F.when(centric & (line >= half - band) & (line < half + band + 1), n_poses).otherwise(of)

    planes = planes.withColumn("poses", F.transform(F.sequence(F.lit(0), n - 1), pose_of))
    each = planes.withColumn("pose", F.explode(F.array_distinct("poses")))
    calm, reach = F.when(F.col("pose") == n_poses, 0.25).otherwise(1.0), 0.1 * severity * F.least(n, other)
    for name, most in (("dy", reach), ("dx", reach), ("turn", F.lit(6.0) * severity)):
        each = each.withColumn(name, calm * most * (2 * drawn(name, F.col("pose")) - 1))
    each = spectra(each.withColumn("values", rotated(F.col("turn"))))

    def shifted(ky: Column) -> Column:
        """A line of the pose's spectrum; a shift of the head is a turn of its phase."""
        phase = lambda kx: -2 * math.pi * (F.col("dy") * T.frequency(ky, n) / n + F.col("dx") * T.frequency(kx, other) / other)
        return F.struct(ky.alias("ky"), F.transform(F.slice("z", ky * other + 1, other), lambda z, kx: T.times(z, T.turn(phase(kx)))).alias("line"))

    own = F.filter(F.sequence(F.lit(0), n - 1), lambda ky: F.get("poses", ky) == F.col("pose"))
    each = each.withColumn("own", own).withColumn("own", F.transform("own", shifted))
    whole = each.groupBy("_uid", "k").agg(*[F.first(c).alias(c) for c in ("shape", "axis", "ny", "nx")], F.array_sort(F.flatten(F.collect_list("own"))).alias("own"))
    return volumes_of(images(whole.withColumn("z", F.flatten("own.line")), magnitude))


def smoothed(a: Column, sigma: Column) -> Column:
    """Of a line: a Gaussian cut at four sigma, mirrored at the ends with the end repeated."""

    def run(x: Column, n: Column, r: Column, s: Column) -> Column:
        offsets = F.sequence(-r, r)
        taps = F.transform(offsets, lambda d: F.exp(-0.5 * d * d / (s * s)))

        def mirror(at: Column) -> Column:
            p = F.pmod(at, 2 * n)
            return F.when(p < n, p).otherwise(2 * n - 1 - p)

        return A.let(lambda w, total: F.transform(x, lambda _, at: A.total(F.zip_with(offsets, w, lambda d, t: t / total * F.get(x, mirror(at + d))))), taps, A.total(taps))

    return A.let(lambda x, s: A.let(run, x, F.size(x), F.floor(4 * s + 0.5).cast("int"), s), a, sigma)


@operator("motion_continuous", "kspace", "3d", (0.0, 1.0), lowering="job", pool=True, has_detector=True)
def motion_continuous(volumes: DataFrame, severity: float, seed: int) -> DataFrame:
    """One smooth random walk of the head, of zero mean, shifts each phase-encoding line along both axes."""
    planes = slices(volumes, F.lit(0))
    ny, nx = F.col("ny"), F.col("nx")
    reach = 0.12 * severity * F.least(ny, nx)
    for name in ("y", "x"):
        steps = F.transform(F.sequence(F.lit(0), ny - 1), _step(seed, name))
        so_far = A.let(lambda s: F.transform(s, lambda _, r: A.total(F.slice(s, 1, r + 1))), steps)
        planes = planes.withColumn(name, smoothed(so_far, ny / 8.0))
        centred = A.let(lambda w: A.let(lambda m: F.transform(w, lambda x: x - m), A.mean(w)), F.col(name))
        planes = planes.withColumn(name, A.let(lambda w: A.let(lambda most: F.transform(w, lambda x: x / (most + 1e-9) * reach), F.array_max(F.transform(w, F.abs))), centred))

    def shifted(z: Column, at: Column) -> Column:
        ky, kx = F.floor(at / nx).cast("int"), at % nx
        line = _line(ky, ny)
        return T.times(z, T.turn(-2 * math.pi * (F.get("y", line) * T.frequency(ky, ny) / ny + F.get("x", line) * T.frequency(kx, nx) / nx)))

    return volumes_of(images(spectra(planes).withColumn("z", F.transform("z", shifted))))


def _step(seed: int, name: str) -> Callable[[Column], Column]:
    return lambda r: draws.normal(F.lit(seed), F.col("case_id"), "motion_continuous", name, r)
