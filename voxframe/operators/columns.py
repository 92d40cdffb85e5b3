"""Operators lowered to Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import arrays as A
from .registry import ColumnVolume, operator

_double = "array<double>"


def _clip(a: Column) -> Column:
    return F.transform(a, lambda x: A.clip(x))


def _centre(v: ColumnVolume, axis: int) -> Column:
    return (v.size(axis) - 1) / 2.0


# intensity


@operator("clipping", "intensity", "3d", (0.0, 1.0), lowering="column", pool=True, has_detector=True, identity_at_zero=False)
def clipping(v: ColumnVolume, severity: float, percentile: float | None = None) -> Column:
    """Values above a percentile of the head (or, if one is given, of the positives) are cut to it."""
    if percentile is None:
        q, region = 99.5 - 25.0 * severity, A.where(v.voxels, v.mask, lambda x, m: m)
        region = F.when(F.size(region) > 0, region).otherwise(F.filter(v.voxels, lambda x: x > 0.1 * F.array_max(v.voxels)))
    else:
        q, region = percentile, A.positives(v.voxels)
    return A.let(lambda cap: F.transform(v.voxels, lambda x: F.when(cap.isNull(), x).otherwise(F.least(x, cap))), A.percentile(region, q))


@operator("quantization", "intensity", "3d", (0.0, 1.0), lowering="column", pool=True)
def quantization(v: ColumnVolume, severity: float, levels: int | None = None, lut_warp: float | None = None, dither: bool | None = None) -> Column:
    """Min-max normalised values on N levels, rounded half to even, with optional dither and power warp."""
    low, high = F.array_min(v.voxels), F.array_max(v.voxels)
    if levels is None:
        centre = math.log(4096) - severity * math.log(1024)
        n = F.least(F.greatest(F.round(F.exp(v.between(centre - 0.35, centre + 0.35, "levels"))), F.lit(4.0)), F.lit(4096.0))
    else:
        n = F.lit(float(levels))
    gamma = F.lit(float(lut_warp)) if lut_warp is not None else F.when(v.uniform("warp") < 0.5, v.between(0.6, 1.6, "gamma")).otherwise(F.lit(1.0))
    dithered = F.lit(dither) if dither is not None else v.uniform("dither") < 0.4

    def one(x, idx, low, high, n, gamma, dithered) -> Column:
        unit = A.clip((x - low) / (high - low))
        unit = F.when(dithered, A.clip(unit + (v.uniform("voxel", idx) - 0.5) / (n - 1))).otherwise(unit) if dither is not False else unit
        stepped = F.bround(F.pow(unit, gamma) * (n - 1)) / (n - 1)
        return low + (high - low) * F.pow(stepped, 1.0 / gamma)

    return A.let(lambda *s: F.when(s[1] > s[0], F.transform(v.voxels, lambda x, i: one(x, i, *s))).otherwise(v.voxels), low, high, n, gamma, dithered)


@operator("brain_intensity", "intensity", "either", (0.1, 3.0), lowering="column", identity_at_zero=False)
def brain_intensity(v: ColumnVolume, severity: float, intensity_change: float | None = None, add: float | None = None, normalize: bool | None = None) -> Column:
    """Voxels in the mask times a factor (severity held to [0.1, 3] unless given), clipped."""
    factor = intensity_change if intensity_change is not None else min(3.0, max(0.1, severity))
    out = v.map_masked(lambda x, m, _: F.when(m, x * factor + (add or 0.0)).otherwise(x))
    return _unit(out) if normalize else _clip(out)


@operator("skull_intensity", "intensity", "either", (0.1, 3.0), lowering="column", identity_at_zero=False)
def skull_intensity(v: ColumnVolume, severity: float, intensity_change: float | None = None, add: float | None = None, normalize: bool | None = None) -> Column:
    """As brain_intensity, for voxels above 0.1 outside the mask."""
    factor = intensity_change if intensity_change is not None else min(3.0, max(0.1, severity))
    out = v.map_masked(lambda x, m, _: F.when(~m & (x > 0.1), x * factor + (add or 0.0)).otherwise(x))
    return _unit(out) if normalize else _clip(out)


def _unit(a: Column) -> Column:
    return A.let(lambda w: A.let(lambda low, high: F.transform(w, lambda x: F.coalesce(A.try_divide(x - low, high - low), F.lit(0.0))), F.array_min(w), F.array_max(w)), a)


def _contrast(v: ColumnVolume, factor: float, test) -> Column:
    m = A.mean(A.where(v.voxels, v.mask, lambda x, inside: test(x, inside)))
    return _clip(A.let(lambda m: v.map_masked(lambda x, inside, _: F.when(test(x, inside) & m.isNotNull(), (x - m) * factor + m).otherwise(x)), m))


@operator("brain_contrast", "intensity", "either", (0.0, 3.0), lowering="column", identity_at_zero=False)
def brain_contrast(v: ColumnVolume, severity: float, contrast_factor: float | None = None) -> Column:
    """Contrast about the mean within the mask, clipped."""
    return _contrast(v, severity if contrast_factor is None else contrast_factor, lambda x, m: m)


@operator("skull_contrast", "intensity", "either", (0.0, 3.0), lowering="column", identity_at_zero=False)
def skull_contrast(v: ColumnVolume, severity: float, contrast_factor: float | None = None) -> Column:
    """Contrast about the mean of what is above 0.1 outside the mask, clipped."""
    return _contrast(v, severity if contrast_factor is None else contrast_factor, lambda x, m: ~m & (x > 0.1))


def _lobe(v: ColumnVolume, low: float, high: float, severity: float) -> Column:
    """One Gaussian lobe that multiplies the signal, at a drawn centre."""
    strength = v.between(low, high, "strength") * severity * F.when(v.uniform("sign") < 0.5, -1.0).otherwise(1.0)
    sigma = v.between(0.06, 0.13, "scale") * (v.size(0) + v.size(1) + v.size(2)) / 3.0
    c = [v.between(0.2, 0.8, f"c{a}") * (v.size(a) - 1) for a in range(3)]

    def lobe(strength, sigma, *c) -> Column:
        r2 = lambda i, j, k: (i - c[0]) * (i - c[0]) + (j - c[1]) * (j - c[1]) + (k - c[2]) * (k - c[2])
        return v.map(lambda x, i, j, k: A.clip(x * (1.0 + strength * F.exp(-r2(i, j, k) / (2.0 * sigma * sigma)))))

    return A.let(lobe, strength, sigma, *c)


@operator("draw_shape", "intensity", "either", (0.0, 1.0), lowering="column", pool=True)
def draw_shape(v: ColumnVolume, severity: float) -> Column:
    """A focal lobe of 0.3 to 0.8 times the severity, brighter or darker."""
    return _lobe(v, 0.3, 0.8, severity)


@operator("draw_shape_opacity", "intensity", "either", (0.0, 1.0), lowering="column")
def draw_shape_opacity(v: ColumnVolume, severity: float) -> Column:
    """A fainter lobe, 0.1 to 0.3 times the severity."""
    return _lobe(v, 0.1, 0.3, severity)


@operator("random_erasing", "intensity", "either", (0.0, 1.0), lowering="column", pool=True)
def random_erasing(v: ColumnVolume, severity: float, magnitude_noise: bool = False) -> Column:
    """One or two peripheral lobes in which the signal fades and the noise floor rises."""
    spread = F.coalesce(A.std(v.voxels), F.lit(0.0))
    lobes = []
    for n in range(2):
        axis_far = [F.when(v.uniform("side", n, a) < 0.5, v.between(0.0, 0.25, "c", n, a)).otherwise(v.between(0.75, 1.0, "c", n, a)) * (v.size(a) - 1) for a in range(3)]
        sigma = v.between(0.12, 0.25, "s", n) * (v.size(0) + v.size(1) + v.size(2)) / 3.0
        present = F.lit(1.0) if n == 0 else F.when(v.uniform("two") < 0.5, 1.0).otherwise(0.0)
        lobes.append((axis_far, sigma, present))

    def one(x, idx, spread, *s) -> Column:
        place, keep = v.ijk(idx), F.lit(1.0)
        for c, sigma, present in ((s[:3], s[3], s[4]), (s[5:8], s[8], s[9])):
            r2 = sum(((p - q) * (p - q) for p, q in zip(place, c, strict=True)), F.lit(0.0))
            keep = keep * (1.0 - severity * present * F.exp(-r2 / (2.0 * sigma * sigma)))
        noise = 0.15 * severity * spread * (1.0 - keep)
        signed = x * keep + noise * v.normal("n", idx)
        if magnitude_noise:
            other = noise * v.normal("q", idx)
            signed = F.sqrt(signed * signed + other * other)
        return A.clip(signed)

    flat = [x for c, sigma, present in lobes for x in (*c, sigma, present)]
    return A.let(lambda *s: F.transform(v.voxels, lambda x, i: one(x, i, *s)), spread, *flat)


@operator("bounce_point_null", "intensity", "3d", (0.0, 1.0), lowering="column", pool=True, train=(0.15, 0.45))
def bounce_point_null(v: ColumnVolume, severity: float, centre: float | None = None, width: float | None = None) -> Column:
    """Signal near a null value is pulled towards zero, with a V-shaped refill at the null itself."""
    positive = A.positives(v.voxels)
    at, wide = (F.lit(centre) if centre is not None else v.between(0.25, 0.75, "centre")), (F.lit(width) if width is not None else v.between(0.08, 0.2, "width"))
    depth = 0.6 + 0.4 * severity

    def one(x: Column, null: Column, sigma: Column) -> Column:
        d = x - null
        gone = depth * F.exp(-(d * d) / (2.0 * sigma * sigma))
        refill = 0.5 * severity * F.greatest(F.lit(0.0), 1.0 - F.abs(d) / sigma) * F.abs(d)
        return F.when((x > 0) & (sigma > 0), A.clip(x * (1.0 - gone) + refill)).otherwise(x)

    def run(low: Column, high: Column, at: Column, wide: Column) -> Column:
        return A.let(lambda null, sigma: F.transform(v.voxels, lambda x: one(x, null, sigma)), low + (high - low) * at, (high - low) * wide)

    return A.let(run, A.percentile(positive, 5.0), A.percentile(positive, 95.0), at, wide)


@operator("mp2rage_lut", "intensity", "2d", (0.0, 1.0), lowering="column", identity_at_zero=False)
def mp2rage_lut(v: ColumnVolume, severity: float, xs: tuple = (0.0, 0.3, 0.6, 1.0), ys: tuple = (0.0, 0.5, 0.8, 1.0), per_region: bool = True) -> Column:
    """A piecewise-linear curve on values normalised by their 0.5th and 99.5th percentile; bad knots leave all as is."""
    xs, ys = list(xs), list(ys)
    if len(xs) != len(ys) or len(xs) < 2 or any(b <= a for a, b in zip(xs, xs[1:], strict=False)) or not all(map(math.isfinite, [*xs, *ys])):
        return v.voxels
    inside = (lambda x, m: m) if per_region else (lambda x, m: x > 0)
    region = A.where(v.voxels, v.mask, inside)

    def curve(t: Column) -> Column:
        out = F.when(t <= xs[0], F.lit(float(ys[0])))
        for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:], strict=False):
            out = out.when(t <= x1, y0 + (t - x0) * ((y1 - y0) / (x1 - x0)))
        return out.otherwise(F.lit(float(ys[-1])))

    def run(low: Column, high: Column) -> Column:
        return v.map_masked(lambda x, m, _: F.when(inside(x, m) & (high > low), curve(A.clip((x - low) / (high - low)))).otherwise(x))

    return A.let(run, A.percentile(region, 0.5), A.percentile(region, 99.5))


# noise


@operator("noise_overlay", "noise", "either", (0.0, 1.0), lowering="column", identity_at_zero=False)
def noise_overlay(v: ColumnVolume, severity: float, orig: bool | None = None, low: float = 0.0, brain_only: bool = False) -> Column:
    """A uniform value between `low` and the severity is added to each voxel, clipped."""
    return v.map_masked(lambda x, m, idx: F.when(F.lit(not brain_only) | m, A.clip(x + low + (severity - low) * v.uniform("n", idx))).otherwise(x))


def _line_noise(v: ColumnVolume, severity: float, per_voxel: bool) -> Column:
    """Background runs at both ends of each line of the last axis, up to 0.05, get uniform values."""
    n = v.size(2)
    lines = F.transform(F.sequence(F.lit(0), (F.size(v.voxels) / n).cast("int") - 1), lambda r: F.slice(v.voxels, r * n + 1, n))

    def one(line: Column, r: Column) -> Column:
        places = F.filter(F.transform(line, lambda x, k: F.when(x > 0.05, k).otherwise(-1)), lambda k: k >= 0)
        return A.let(lambda p, bound: ends(line, r, F.coalesce(F.array_min(p), n), F.coalesce(F.array_max(p), F.lit(-1)), bound), places, severity * v.between(0.05, 0.2, "bound", r))

    def ends(line: Column, r: Column, first: Column, last: Column, bound: Column) -> Column:
        return A.let(lambda a, b: filled(line, r, a, b, bound), first, last)

    def filled(line: Column, r: Column, first: Column, last: Column, bound: Column) -> Column:
        def voxel(x: Column, k: Column) -> Column:
            value = bound * v.uniform("voxel", r, k) if per_voxel else bound
            return F.when((k < first) | (k > last), value).otherwise(x)

        return F.transform(line, voxel)

    return F.flatten(F.transform(lines, one))


@operator("noise_straight", "noise", "either", (0.0, 1.0), lowering="column", identity_at_zero=False)
def noise_straight(v: ColumnVolume, severity: float) -> Column:
    """One value for the background of each line."""
    return _line_noise(v, severity, False)


@operator("noise_random", "noise", "either", (0.0, 1.0), lowering="column", identity_at_zero=False)
def noise_random(v: ColumnVolume, severity: float) -> Column:
    """A value of its own for each background voxel of a line."""
    return _line_noise(v, severity, True)


@operator("signal_drop_band", "noise", "either", (0.0, 1.0), lowering="column", pool=True, has_detector=True, identity_at_zero=False)
def signal_drop_band(v: ColumnVolume, severity: float, heavy_tail: bool | None = None, axis: int = 0) -> Column:
    """One or two smooth bands of lower signal across an axis, never below 0.15 of it."""
    n = v.size(axis)
    bands = []
    for b in range(2):
        width = v.between(0.03, 0.30, "width", b) * n
        depth = severity * (F.pow(v.uniform("depth", b), 0.5) if heavy_tail else v.between(0.4, 1.0, "depth", b))
        bands.append((v.uniform("centre", b) * (n - 1), width / 2.0, depth * (F.lit(1.0) if b == 0 else F.when(v.uniform("two") < 0.4, 1.0).otherwise(0.0))))

    def one(x: Column, at: Column, s: tuple) -> Column:
        weight = F.lit(1.0)
        for c, wide, depth in (s[:3], s[3:]):
            weight = weight * (1.0 - depth * F.exp(-((at - c) * (at - c)) / (2.0 * wide * wide)))
        return x * F.greatest(weight, F.lit(0.15))

    return A.let(lambda *s: v.map(lambda x, *place: one(x, place[axis], s)), *[x for b in bands for x in b])


@operator("mp2rage_tissue_noise", "noise", "2d", (0.0, 1.0), lowering="column", identity_at_zero=False)
def mp2rage_tissue_noise(v: ColumnVolume, severity: float, noise: float | None = None) -> Column:
    """Normal noise of the given deviation (the severity if none) within the mask."""
    sigma = severity if noise is None else noise
    return v.map_masked(lambda x, m, idx: F.when(m, x + sigma * v.normal("n", idx)).otherwise(x))


@operator("rician_noise", "noise", "3d", (0.0, 0.6), lowering="column", pool=True, train=(0.1, 0.6))
def rician_noise(v: ColumnVolume, severity: float) -> Column:
    """The magnitude of the signal with complex normal noise, scaled by the 90th percentile of the positives."""
    sigma = (0.03 + 0.45 * severity) * F.coalesce(A.percentile(A.positives(v.voxels), 90.0), F.lit(0.0))

    def one(x: Column, idx: Column, sigma: Column) -> Column:
        a, b = x + sigma * v.normal("a", idx), sigma * v.normal("b", idx)
        return F.sqrt(a * a + b * b)

    return A.let(lambda s: F.transform(v.voxels, lambda x, i: one(x, i, s)), sigma)


@operator("mp2rage_background", "noise", "2d", (0.0, 1.0), lowering="column", identity_at_zero=False)
def mp2rage_background(v: ColumnVolume, severity: float, thr_frac: float = 0.1, amp: float = 0.5, bg_model: str = "uniform", fov_zero_prob: float = 0.0, fov_zero_frac: float = 0.25) -> Column:
    """Low signal outside the mask is replaced by a field: uniform, or the ratio of complex noise ('complex')."""
    if bg_model not in ("uniform", "complex"):
        raise ValueError(f"unknown background model {bg_model!r}")
    least = thr_frac * F.coalesce(A.percentile(A.positives(v.voxels), 99.0), F.lit(0.0))
    wedge = v.uniform("wedge") < fov_zero_prob

    def one(x: Column, m: Column, idx: Column, least: Column, wedge: Column) -> Column:
        if bg_model == "uniform":
            field = 2.0 * amp * v.uniform("n", idx)
        else:  # real part of the product over the sum of squares of two complex draws, shifted to [0, 1]
            a, b, c, d = (v.normal(p, idx) for p in "abcd")
            field = 2.0 * amp * (0.5 + (a * c + b * d) / (a * a + b * b + c * c + d * d))
        cut = wedge & (v.ijk(idx)[0] < fov_zero_frac * v.size(0))
        return F.when(~m & (x < least), F.when(cut, 0.0).otherwise(A.clip(field))).otherwise(x)

    return A.let(lambda a, b: v.map_masked(lambda x, m, i: one(x, m, i, a, b)), least, wedge)


# focal


@operator("dropout", "focal", "3d", (0.0, 1.0), lowering="column", pool=True, train=(0.2, 0.5), has_detector=True)
def dropout(v: ColumnVolume, severity: float, mode: str = "slice") -> Column:
    """'slice': some slices of the last axis lose half their signal or more; 'patch': cuboids are zeroed."""
    if mode == "slice":
        n = v.size(2)
        order = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(v.uniform("slice", k).alias("u"), k.alias("k"))))
        hit = F.transform(F.slice(order, 1, F.greatest(F.lit(0), F.bround(severity * n).cast("int"))), lambda s: s["k"])
        return A.let(lambda h: v.map(lambda x, i, j, k: F.when(F.array_contains(h, k), x * (1.0 - v.between(0.5, 1.0, "loss", k))).otherwise(x)), hit)
    if mode != "patch":
        raise ValueError(f"unknown mode {mode!r}")
    boxes = []
    for b in range(1 + int(5 * severity)):
        side = [F.greatest(F.lit(1), F.floor(v.between(0.1, 0.25, "size", b, a) * v.size(a)).cast("int")) for a in range(3)]
        low = [F.floor(v.uniform("low", b, a) * (v.size(a) - side[a] + 1)).cast("int") for a in range(3)]
        boxes.append((low, side))

    def one(x: Column, place: tuple, s: tuple) -> Column:
        inside = F.lit(False)
        for b in range(0, len(s), 6):
            own = F.lit(True)
            for p, q, n in zip(place, s[b : b + 3], s[b + 3 : b + 6], strict=True):
                own &= (p >= q) & (p < q + n)
            inside |= own
        return F.when(inside, 0.0).otherwise(x)

    return A.let(lambda *s: v.map(lambda x, *place: one(x, place, s)), *[x for low, side in boxes for x in (*low, *side)])


def _offsets(v: ColumnVolume, place, cx: float, cy: float, cz: float | None):
    """Distances from a centre given relative to the volume's middle, by axis."""
    return [p - _centre(v, a) - c for a, (p, c) in enumerate(zip(place, (cx, cy, cz or 0.0), strict=True))]


@operator("metal_dipole", "focal", "either", (0.0, 1.0), lowering="column", has_detector=True, identity_at_zero=False)
def metal_dipole(v: ColumnVolume, severity: float, cx: float = 0.0, cy: float = 0.0, cz: float | None = None, orientation: float = 0.0, radius: float = 18.0, amp: float = 0.6) -> Column:
    """A dipole's field (3 cos^2 - 1) about the last axis under a Gaussian of the distance."""

    def one(x: Column, *place: Column) -> Column:
        d0, d1, d2 = _offsets(v, place, cx, cy, cz)
        r2 = d0 * d0 + d1 * d1 + d2 * d2
        along = d2 * math.cos(orientation) + d0 * math.sin(orientation)
        cos2 = F.coalesce(A.try_divide(along * along, r2), F.lit(0.0))
        return x + amp * (3.0 * cos2 - 1.0) * F.exp(-r2 / (2.0 * radius * radius))

    return v.map(one)


@operator("metal_void", "focal", "either", (0.0, 1.0), lowering="column", pool=True, has_detector=True, identity_at_zero=False)
def metal_void(v: ColumnVolume, severity: float, cx: float = 0.0, cy: float = 0.0, cz: float | None = None, radius: float = 12.0, radius_mm: float | None = None, voxel_sizes: tuple | None = None, depth: float = 0.7) -> Column:
    """Signal lost around a centre; with radius_mm and voxel_sizes the distance is physical."""
    scale = tuple(voxel_sizes) if radius_mm is not None and voxel_sizes else (1.0, 1.0, 1.0)
    r = radius_mm if radius_mm is not None and voxel_sizes else radius

    def one(x: Column, *place: Column) -> Column:
        r2 = sum((d * s * d * s for d, s in zip(_offsets(v, place, cx, cy, cz), scale, strict=True)), F.lit(0.0))
        return x * (1.0 - depth * F.exp(-r2 / (2.0 * r * r)))

    return v.map(one)


@operator("metal_pileup", "focal", "either", (0.0, 1.0), lowering="column", has_detector=True, identity_at_zero=False)
def metal_pileup(v: ColumnVolume, severity: float, cx: float = 0.0, cy: float = 0.0, cz: float | None = None, radius: float = 14.0, amp: float = 0.4, width: float = 4.0) -> Column:
    """A bright shell around a centre."""

    def one(x: Column, *place: Column) -> Column:
        r = F.sqrt(sum((d * d for d in _offsets(v, place, cx, cy, cz)), F.lit(0.0)))
        return x + amp * F.exp(-((r - radius) * (r - radius)) / (2.0 * width * width))

    return v.map(one)


def master(t: float, clean: float, real: float, extreme: float) -> float:
    """A setting by master strength: clean to real on [0, 1], real to extreme on (1, 1.3]."""
    if t <= 1:
        return clean + (real - clean) * max(0.0, t)
    return real + (extreme - real) * min(1.0, (t - 1.0) / 0.3)


@operator("metal_3d", "focal", "3d", (0.0, 1.3), lowering="column", pool=True, has_detector=True, identity_at_zero=False)
def metal_3d(v: ColumnVolume, severity: float, master_t: float | None = None, loc: tuple | None = None, size_scale: float = 1.0) -> Column:
    """Void, dipole and pile-up at one centre, all by one master strength; identity at 0."""
    t = severity if master_t is None else master_t
    if t <= 0:
        return v.voxels
    void, pole, pile = master(t, 0, 0.7, 0.95), master(t, 0, 0.35, 0.6), master(t, 0, 0.3, 0.5)
    radius = F.lit(size_scale) * 0.12 * (v.size(0) + v.size(1) + v.size(2)) / 3.0 * (0.6 + 0.4 * min(t, 1.3))
    centre = [F.lit(float(c)) for c in loc] if loc else [v.between(0.3, 0.7, f"c{a}") * (v.size(a) - 1) for a in range(3)]

    def one(x: Column, place: tuple, radius: Column, *centre: Column) -> Column:
        d = [p - c for p, c in zip(place, centre, strict=True)]
        r2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        fall = F.exp(-r2 / (2.0 * radius * radius))
        cos2 = F.coalesce(A.try_divide(d[2] * d[2], r2), F.lit(0.0))
        ring = F.sqrt(r2) - 1.2 * radius
        out = x * (1.0 - void * fall) + pole * (3.0 * cos2 - 1.0) * F.exp(-r2 / (4.5 * radius * radius)) * x
        return A.clip(out + pile * F.exp(-ring * ring / (0.18 * radius * radius)) * x)

    return A.let(lambda *s: v.map(lambda x, *place: one(x, place, *s)), radius, *centre)


@operator("defacing", "focal", "3d", (0.0, 1.0), lowering="column", label_preserving=False)
def defacing(v: ColumnVolume, severity: float, axis: int = 1, low_side: bool = True) -> Column:
    """Voxels beyond a tilted plane on the face side are zeroed; below 0.45 severity the plane stays clear of the mask."""
    inside = F.filter(F.transform(v.mask, lambda m, idx: F.when(m, v.ijk(idx)[axis]).otherwise(-1)), lambda p: p >= 0)
    n = v.size(axis)
    edge = F.coalesce(F.array_min(inside) if low_side else F.array_max(inside), F.lit(0) if low_side else n - 1)
    reach = edge * 1.0 if low_side else (n - 1 - edge) * 1.0
    cut = reach * min(1.0, severity / 0.45) if severity < 0.45 else reach + (severity - 0.45) * 0.25 * n

    def one(x: Column, m: Column, idx: Column, cut: Column, tilt: Column) -> Column:
        place = v.ijk(idx)
        depth = place[axis] if low_side else n - 1 - place[axis]
        beyond = depth + tilt * (place[2] - _centre(v, 2)) < cut
        return F.when(beyond & (~m if severity < 0.45 else F.lit(True)), 0.0).otherwise(x)

    return A.let(lambda a, b: v.map_masked(lambda x, m, i: one(x, m, i, a, b)), cut, v.between(-0.2, 0.2, "tilt"))


# structure, meta


@operator("spin_history", "structure", "3d", (0.0, 1.0), lowering="column", pool=True)
def spin_history(v: ColumnVolume, severity: float, axis: int = 2, k: int | None = None, drift: float | None = None) -> Column:
    """Every k-th slice differs by a constant factor, with an optional linear drift over the slices."""
    period = F.lit(k) if k is not None else F.get(F.array(*[F.lit(p) for p in (2, 2, 2, 3, 4)]), F.floor(v.uniform("period") * 5).cast("int"))
    amplitude = 0.03 + 0.30 * severity
    ramp = F.lit(float(drift)) if drift is not None else F.when(v.uniform("drifts") < 0.5, v.between(-0.1, 0.1, "drift")).otherwise(F.lit(0.0))

    def one(x: Column, place: tuple, period: Column, ramp: Column) -> Column:
        at, n = place[axis], v.size(axis)
        band = F.when(at % period == 0, amplitude).otherwise(-amplitude / 2.0)
        return A.clip(x * (1.0 + band + ramp * (at / F.greatest(n - 1, F.lit(1)) - 0.5)))

    return A.let(lambda a, b: v.map(lambda x, *place: one(x, place, a, b)), period, ramp)


@operator("nonfinite", "meta", "either", (0.0, 0.05), lowering="column", has_detector=True)
def nonfinite(v: ColumnVolume, severity: float) -> Column:
    """A share of the voxels, the severity, becomes NaN."""
    return F.transform(v.voxels, lambda x, idx: F.when(v.uniform("n", idx) < severity, F.lit(float("nan"))).otherwise(x))


@operator("constant", "meta", "either", (0.0, 1.0), lowering="column", label_preserving=False, has_detector=True)
def constant(v: ColumnVolume, severity: float) -> Column:
    """All voxels become the median of the positives, 1 if there are none."""
    value = F.coalesce(A.median(A.positives(v.voxels)), F.lit(1.0))
    return A.let(lambda c: F.transform(v.voxels, lambda _: c), value)


# k-space operators with a closed form in image space


def blend_ghosts(v: ColumnVolume, axis: int, shifts: list[Column], weights: list[Column]) -> Column:
    """(1 - sum of weights) times the image plus weighted rolled copies."""
    rest = 1.0 - sum(weights, F.lit(0.0))

    def one(x: Column, *place: Column) -> Column:
        out = rest * x
        for by, w in zip(shifts, weights, strict=True):
            p = list(place)
            p[axis] = F.pmod(p[axis] - by, v.size(axis)).cast("int")
            out = out + w * v.at(*p)
        return out

    return v.map(one)


@operator("motion_pe_replicas", "kspace", "2d", (0.0, 1.0), lowering="column", has_detector=True, identity_at_zero=False)
def motion_pe_replicas(v: ColumnVolume, severity: float, pe_axis: int = 0, shifts: tuple = (), alphas: tuple = ()) -> Column:
    """The image and copies rolled along the phase axis, weights summing to 1."""
    return blend_ghosts(v, pe_axis, [F.lit(int(s)) for s in shifts], [F.lit(float(a)) for a in alphas])


@operator("motion_ghost_stack", "kspace", "2d", (0.0, 1.0), lowering="column", has_detector=True, identity_at_zero=False)
def motion_ghost_stack(v: ColumnVolume, severity: float, pe_axis: int = 0, offsets: tuple = (), alphas: tuple = ()) -> Column:
    """Each rolled copy of the original is blended over what is there so far."""
    shares, rest = [], 1.0
    for a in reversed(alphas):
        shares.insert(0, a * rest)
        rest *= 1.0 - a
    return blend_ghosts(v, pe_axis, [F.lit(int(o)) for o in offsets], [F.lit(float(s)) for s in shares])


@operator("motion_pulsation", "kspace", "2d", (0.0, 1.0), lowering="column", has_detector=True, identity_at_zero=False)
def motion_pulsation(v: ColumnVolume, severity: float, pe_axis: int = 0, offsets: tuple = (), alphas: tuple = (), bright_pct: float = 95.0, least: int = 50) -> Column:
    """Rolled copies of the brightest voxels in the mask are added; fewer than `least` in the mask change nothing."""
    region = A.where(v.voxels, v.mask, lambda x, m: m)

    def one(x: Column, place: tuple, bright: Column) -> Column:
        out = x
        for o, a in zip(offsets, alphas, strict=True):
            p = list(place)
            p[pe_axis] = F.pmod(p[pe_axis] - int(o), v.size(pe_axis)).cast("int")
            at = ((p[0] * v.size(1) + p[1]) * v.size(2) + p[2]).cast("int")
            out = out + float(a) * F.get(bright, at)
        return A.clip(out)

    def run(r: Column, bar: Column) -> Column:
        bright = v.map_masked(lambda x, m, _: F.when(m & (x >= bar), x).otherwise(0.0))
        return F.when(F.size(r) >= least, A.let(lambda b: v.map(lambda x, *place: one(x, place, b)), bright)).otherwise(v.voxels)

    return A.let(run, region, A.percentile(region, bright_pct))


@operator("ghosting", "kspace", "3d", (0.0, 1.0), lowering="column", pool=True, has_detector=True)
def ghosting(v: ColumnVolume, severity: float, n_ghosts: int | None = None, axis: int = 1, amplitude: float | None = None) -> Column:
    """Rolled copies are added, the first about half the field away; the sum is windowed by its 99.5th percentile if above 1."""
    n = v.size(axis)
    most = n_ghosts or 4
    u = v.uniform("count")
    count = F.lit(n_ghosts) if n_ghosts else F.when(u < 0.55, 1).when(u < 0.80, 2).when(u < 0.93, 3).otherwise(4)
    shifts, weights = [], []
    for g in range(most):
        if n_ghosts:  # an even ladder
            shifts.append(F.bround(F.lit((g + 1) / (n_ghosts + 1)) * n).cast("int"))
        else:
            shifts.append(F.bround(v.between(0.45, 0.55, "at", g) * n * (1.0 if g == 0 else 1.0 / (g + 1))).cast("int"))
        size = F.lit(float(amplitude)) if amplitude is not None else v.between(0.3, 0.6, "amp", g) * severity
        weights.append(F.when(F.lit(g) < count, size / (g + 1)).otherwise(0.0))

    def one(x: Column, place: tuple, s: tuple) -> Column:
        out = x
        for by, w in zip(s[:most], s[most:], strict=True):
            p = list(place)
            p[axis] = F.pmod(p[axis] - by, n).cast("int")
            out = out + w * v.at(*p)
        return out

    def windowed(added: Column, top: Column) -> Column:
        return F.transform(added, lambda x: A.clip(F.when(top > 1, x / top).otherwise(x)))

    added = A.let(lambda *s: v.map(lambda x, *place: one(x, place, s)), *shifts, *weights)
    return A.let(lambda a: A.let(lambda top: windowed(a, top), A.percentile(a, 99.5)), added)


@operator("aliasing", "kspace", "3d", (0.0, 1.0), lowering="column", pool=True, has_detector=True)
def aliasing(v: ColumnVolume, severity: float, axis: int = 0, direction: str | None = None) -> Column:
    """The strip at one edge folds onto the opposite edge, or both do; weights are convex."""
    n = v.size(axis)
    width = F.greatest(F.lit(1), F.bround((0.06 + 0.44 * severity) * n).cast("int"))
    amp = 0.8 + 0.2 * severity
    both = F.lit(direction == "both") if direction else v.uniform("both") < 0.5
    low = F.lit(direction == "low") if direction else v.uniform("low") < 0.5

    def one(x: Column, place: tuple, width: Column, both: Column, low: Column) -> Column:
        at = place[axis]
        p, q = list(place), list(place)
        p[axis] = F.greatest(n - width + at, F.lit(0)).cast("int")
        q[axis] = F.greatest(at - (n - width), F.lit(0)).cast("int")
        onto_low = (at < width) & (both | low)
        onto_high = (at >= n - width) & (both | ~low)
        return F.when(onto_low, (x + amp * v.at(*p)) / (1.0 + amp)).when(onto_high, (x + amp * v.at(*q)) / (1.0 + amp)).otherwise(x)

    return A.let(lambda *s: v.map(lambda x, *place: one(x, place, *s)), width, both, low)


@operator("slab_wrap", "kspace", "3d", (0.0, 1.0), lowering="column", pool=True, has_detector=True)
def slab_wrap(v: ColumnVolume, severity: float, axis: int | None = None, both: bool | None = None, weight: float | None = None, jitter: float | None = None) -> Column:
    """The whole volume rolled along an axis is mixed in, convexly."""
    share = 0.10 + 0.40 * severity
    factor = F.lit(float(jitter)) if jitter is not None else v.between(0.85, 1.15, "jitter")
    w = F.lit(float(weight)) if weight is not None else v.between(0.3, 0.7, "weight")
    twice = F.lit(both) if both is not None else v.uniform("both") < 0.35
    u = v.uniform("axis")
    chosen = F.lit(axis) if axis is not None else F.when(u < 0.2, 0).when(u < 0.4, 1).otherwise(2)

    def one(x: Column, place: tuple, factor: Column, w: Column, twice: Column, chosen: Column) -> Column:
        out = None
        for a in (0, 1, 2) if axis is None else (axis,):
            by = F.greatest(F.lit(1), F.bround(share * factor * v.size(a)).cast("int"))
            p, q = list(place), list(place)
            p[a], q[a] = F.pmod(p[a] - by, v.size(a)).cast("int"), F.pmod(q[a] + by, v.size(a)).cast("int")
            own = F.when(twice, (x + w * v.at(*p) + w * v.at(*q)) / (1.0 + 2.0 * w)).otherwise((x + w * v.at(*p)) / (1.0 + w))
            out = F.when(chosen == a, own) if out is None else out.when(chosen == a, own)
        return out

    return A.let(lambda *s: v.map(lambda x, *place: one(x, place, *s)), factor, w, twice, chosen)


@operator("nyquist_ghost", "kspace", "3d", (0.0, 1.0), lowering="column", pool=True)
def nyquist_ghost(v: ColumnVolume, severity: float, axis: int | None = None, delta: float | None = None) -> Column:
    """A phase that alternates by line leaves a copy half the field away: |cos d * x + i sin d * rolled x| on even axes."""
    d = F.lit(float(delta)) if delta is not None else v.between(0.15, 0.45, "delta") * severity
    a = 1 if axis is None else axis

    def one(x: Column, place: tuple, d: Column) -> Column:
        p = list(place)
        p[a] = F.pmod(p[a] - F.floor(v.size(a) / 2).cast("int"), v.size(a)).cast("int")
        c, s = F.cos(d) * x, F.sin(d) * v.at(*p)
        return F.sqrt(c * c + s * s)

    return A.let(lambda d: v.map(lambda x, *place: one(x, place, d)), d)


def _waves(v: ColumnVolume, severity: float, n: int) -> Column:
    """Points in k-space and their mirrors are plane waves in the image; the reference amplitude is the image's sum, the largest magnitude there."""
    peak = F.abs(A.total(v.voxels)) / F.size(v.voxels)
    size = (0.05 + 0.45 * severity) * peak
    waves = []
    for s in range(n):
        f = [F.floor(v.between(0.1, 0.5, "f", s, a) * v.size(a)) * F.when(v.uniform("sign", s, a) < 0.5, -1).otherwise(1) for a in range(3)]
        waves.append((f, 2.0 * math.pi * v.uniform("phase", s)))

    def one(x: Column, place: tuple, size: Column, *s: Column) -> Column:
        total = x
        for w in range(0, len(s), 4):
            turn = sum((2.0 * math.pi * q * p / v.size(a) for a, (q, p) in enumerate(zip(s[w : w + 3], place, strict=True))), F.lit(0.0))
            total = total + 2.0 * size * F.cos(turn + s[w + 3])
        return total

    return A.let(lambda *s: v.map(lambda x, *place: one(x, place, *s)), size, *[x for f, phase in waves for x in (*f, phase)])


@operator("spike", "kspace", "3d", (0.0, 1.0), lowering="column", pool=True, has_detector=True)
def spike(v: ColumnVolume, severity: float, n_spikes: int = 1) -> Column:
    """Single bright points in k-space; not clipped."""
    return _waves(v, severity, n_spikes)


@operator("herringbone", "kspace", "3d", (0.0, 1.0), lowering="column", pool=True, has_detector=True)
def herringbone(v: ColumnVolume, severity: float, n_spikes: int = 4) -> Column:
    """Several of them, crossing."""
    return _waves(v, severity, n_spikes)


@operator("zipper", "kspace", "3d", (0.0, 1.0), lowering="column", pool=True, has_detector=True)
def zipper(v: ColumnVolume, severity: float, axis: int = 0, n_lines: int | None = None) -> Column:
    """Dotted lines of alternating sign across an axis, near its centre; strength by the median in the mask."""
    inside = A.where(v.voxels, v.mask, lambda x, m: m)
    ref = F.coalesce(A.median(inside), A.percentile(A.positives(v.voxels), 85.0), F.lit(0.0))
    size = (0.2 + 0.8 * severity) * ref
    other = 1 - axis if axis < 2 else 0
    lines = []
    for b in range(n_lines or 1 + round(2 * severity)):
        centre = F.floor((0.5 + 0.35 * (v.uniform("a", b) + v.uniform("b", b) - 1.0)) * v.size(axis))
        lines.append((centre, F.floor(v.uniform("w", b) * 3) + 1))

    def one(x: Column, place: tuple, size: Column, *s: Column) -> Column:
        hit = F.lit(False)
        for c, w in zip(s[::2], s[1::2], strict=True):
            hit |= (place[axis] >= c) & (place[axis] < c + w)
        tooth = F.when(place[other] % 2 == 0, 1.0).otherwise(-1.0)
        return F.when(hit, A.clip(x + tooth * size)).otherwise(x)

    return A.let(lambda *s: v.map(lambda x, *place: one(x, place, *s)), size, *[x for line in lines for x in line])


@operator("dc_offset", "kspace", "3d", (0.0, 1.0), lowering="column", has_detector=True)
def dc_offset(v: ColumnVolume, severity: float, flat: bool | None = None, n_dots: int | None = None) -> Column:
    """A flat offset, or one or two Gaussian dots at the centre of each slice."""
    is_flat = F.lit(flat) if flat is not None else v.uniform("flat") < 0.15
    offset = F.when(v.uniform("sign") < 0.5, -1.0).otherwise(1.0) * v.between(0.05, 0.25, "offset") * severity
    two = F.lit((n_dots or 1) > 1) if n_dots is not None else v.uniform("two") < 0.5
    dots = [(v.between(1.0, 3.0, "sigma", d), v.between(0.3, 1.0, "amp", d) * severity * (F.lit(1.0) if d == 0 else F.when(two, 1.0).otherwise(0.0)), *[v.between(-1.5, 1.5, "at", d, a) if d else F.lit(0.0) for a in range(2)]) for d in range(2)]

    def one(x: Column, i: Column, j: Column, is_flat: Column, offset: Column, *d: Column) -> Column:
        added = F.lit(0.0)
        for s, amp, a, b in (d[:4], d[4:]):
            p, q = i - _centre(v, 0) - a, j - _centre(v, 1) - b
            added = added + amp * F.exp(-(p * p + q * q) / (2.0 * s * s))
        return A.clip(x + F.when(is_flat, offset).otherwise(added))

    return A.let(lambda *s: v.map(lambda x, i, j, k: one(x, i, j, *s)), is_flat, offset, *[x for d in dots for x in d])
