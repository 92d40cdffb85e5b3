"""Windows of volumes: padding, crops that share their offset, and regions for normalisation.

An offset depends on the case and its draws alone, so a scan and its mask, cropped
one after the other, stay aligned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import arrays as A
from .registry import ColumnVolume


def window(v: ColumnVolume, low: Column, size: tuple[int, int, int], values: Column | None = None) -> Column:
    """The box of `size` that begins at the place `low`, an array of three; what lies outside of the volume is 0."""
    data, (_, nj, nk) = v.voxels if values is None else values, size

    def box(start: Column, source: Column) -> Column:
        def one(idx: Column) -> Column:
            place = [F.floor(idx / (nj * nk)).cast("int"), F.floor(idx / nk).cast("int") % nj, idx % nk]
            at = [p + F.get(start, axis) for axis, p in enumerate(place)]
            inside = F.lit(True)
            for axis, p in enumerate(at):
                inside &= (p >= 0) & (p < v.size(axis))
            return F.when(inside, F.get(source, ((at[0] * v.size(1) + at[1]) * v.size(2) + at[2]).cast("int"))).otherwise(0.0)

        return F.transform(F.sequence(F.lit(0), F.lit(size[0] * nj * nk - 1)), one)

    return A.let(box, low, data)


def padding(v: ColumnVolume, size: tuple[int, int, int]) -> list[Column]:
    """Voxels to set before each axis so that it has `size` at least, half of what lacks, rounded down."""
    return [F.floor(F.greatest(F.lit(0), n - v.size(axis)) / 2).cast("int") for axis, n in enumerate(size)]


def _span(v: ColumnVolume, size: tuple[int, int, int], axis: int) -> Column:
    return F.greatest(v.size(axis), F.lit(size[axis]))


def uniform_low(v: ColumnVolume, size: tuple[int, int, int], name: str = "crop") -> Column:
    """Where a crop begins that may lie anywhere in the padded volume."""
    pads = padding(v, size)
    return F.array(*[F.floor(v.uniform(name, axis) * (_span(v, size, axis) - size[axis] + 1)).cast("int") - pads[axis] for axis in range(3)])


def around_low(v: ColumnVolume, size: tuple[int, int, int], index: Column, name: str = "crop") -> Column:
    """Where a crop begins that holds the voxel `index` and lies in the padded volume; null for a null index."""
    pads = padding(v, size)

    def lows(i: Column) -> Column:
        out = []
        for axis, place in enumerate(v.ijk(i)):
            at = place + pads[axis]
            low, high = F.greatest(F.lit(0), at - size[axis] + 1), F.least(at, _span(v, size, axis) - size[axis])
            out.append(F.when(high > low, low + F.floor(v.uniform(name, axis) * (high - low + 1)).cast("int")).otherwise(low) - pads[axis])
        return F.when(i.isNotNull(), F.array(*out))

    return A.let(lows, index)


def drawn_index(v: ColumnVolume, pool: Column, name: str = "anchor") -> Column:
    """One of the true voxels of `pool` by a keyed draw; null if there are none."""
    at = F.filter(F.transform(pool, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())
    return A.let(lambda a: F.get(a, F.floor(v.uniform(name) * F.size(a)).cast("int")), at)


def foreground_low(v: ColumnVolume, size: tuple[int, int, int], share: float = 1.0) -> Column:
    """In `share` of the draws around a voxel of the mask, if it has any; else anywhere."""
    return F.coalesce(around_low(v, size, F.when(v.uniform("foreground") < share, drawn_index(v, v.mask))), uniform_low(v, size))


def boundary_pool(v: ColumnVolume, inside: Column, outside: Column) -> Column:
    """The voxels that may anchor a crop, by one draw: half the draws within 5 to 15 mm of the surface, a fifth deeper
    than 15 mm (or anywhere inside), a fifth 2 to 20 mm outside; null for the tenth that is uniform."""
    u = v.uniform("kind")
    between = lambda a, lo, hi: F.transform(a, lambda d: (d >= lo) & (d <= hi))
    either = F.zip_with(between(inside, 5, 15), between(outside, 5, 15), lambda a, b: a | b)
    deep = F.transform(inside, lambda d: d > 15)
    deep = F.when(F.exists(deep, lambda m: m), deep).otherwise(F.transform(inside, lambda d: d > 0))
    return F.when(u < 0.10, None).when(u < 0.60, either).when(u < 0.80, deep).otherwise(between(outside, 2, 20))


def boundary_low(v: ColumnVolume, size: tuple[int, int, int], inside: Column, outside: Column) -> Column:
    """Where a crop begins whose anchor is drawn by its distance (mm) to the mask's surface; anywhere if there is no such voxel."""
    some = F.exists(v.mask, lambda m: m)
    return F.coalesce(around_low(v, size, F.when(some, drawn_index(v, boundary_pool(v, inside, outside)))), uniform_low(v, size))


def normalisation_region(v: ColumnVolume, inside: Column, outside: Column, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    """The region whose mean and deviation normalise a training sample: 30 % null (the foreground), 20 % the mask,
    50 % the mask eroded, dilated or moved by up to 4 mm (the mask itself if nothing is left)."""
    u, how, mm = v.uniform("region"), v.uniform("how"), v.between(1.0, 4.0, "mm")
    steps = [F.bround(v.between(-4.0, 4.0, "move", axis) / s).cast("int") for axis, s in enumerate(spacing)]

    def moved(_: Column, idx: Column) -> Column:
        at = [p - s for p, s in zip(v.ijk(idx), steps, strict=True)]
        within = F.lit(True)
        for axis, p in enumerate(at):
            within &= (p >= 0) & (p < v.size(axis))
        return F.coalesce(F.when(within, F.get(v.mask, ((at[0] * v.size(1) + at[1]) * v.size(2) + at[2]).cast("int"))), F.lit(False))

    rough = F.when(how < 0.4, F.transform(inside, lambda d: d > mm)).when(how < 0.8, F.zip_with(v.mask, outside, lambda m, d: m | (d <= mm))).otherwise(F.transform(v.mask, moved))
    rough = A.let(lambda r: F.when(F.exists(r, lambda m: m), r).otherwise(v.mask), rough)
    return F.when(~F.exists(v.mask, lambda m: m) | (u < 0.30), None).when(u < 0.50, v.mask).otherwise(rough)


def posterior_box(v: ColumnVolume, box: Column, margin: int) -> Column:
    """Whether each voxel lies in the posterior half and lower 42 % of a bounding box (measures.bounding_box), `margin` wider on all sides; true everywhere without a box."""
    low, high = box["low"], box["high"]
    ends = [F.get(high, 0) + 1 + margin] + [F.get(low, a) + F.ceil((F.get(high, a) + 1 - F.get(low, a)) * share) + margin for a, share in ((1, 0.50), (2, 0.42))]

    def one(_: Column, idx: Column) -> Column:
        within = F.lit(True)
        for axis, p in enumerate(v.ijk(idx)):
            within &= (p >= F.get(low, axis) - margin) & (p < ends[axis])
        return F.when(box["n"] > 0, within).otherwise(True)

    return F.transform(v.voxels, one)

