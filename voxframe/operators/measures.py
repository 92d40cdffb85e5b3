"""Measures of a volume, within its row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import arrays as A
from .registry import ColumnVolume


def volume(voxels: Column, shape: Column, mask: Column | None = None) -> ColumnVolume:
    return ColumnVolume(voxels, mask if mask is not None else voxels, shape, F.lit(""), 0, "")


def robust_sigma(voxels: Column) -> Column:
    """1.4826 times the median distance from the median over finite values; 0 for fewer than two."""
    v = F.filter(voxels, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return A.let(lambda v: A.let(lambda m: F.when(F.size(v) < 2, 0.0).otherwise(1.4826 * A.median(F.transform(v, lambda x: F.abs(x - m)))), A.median(v)), v)


def plateau_fraction(voxels: Column) -> Column:
    """The share of the most frequent value after rounding to 1/1024, half to even."""
    s = F.array_sort(F.transform(voxels, lambda x: F.bround(A.clip(x) * 1024).cast("int")))
    run = F.aggregate(s, F.struct(F.lit(-1).alias("v"), F.lit(0).alias("n"), F.lit(0).alias("best")), lambda a, x: F.struct(x.alias("v"), F.when(a["v"] == x, a["n"] + 1).otherwise(1).alias("n"), F.greatest(a["best"], F.when(a["v"] == x, a["n"] + 1).otherwise(1)).alias("best")), lambda a: a["best"])
    return run.cast("double") / F.size(voxels)


def otsu(voxels: Column, bins: int = 256) -> Column:
    """The middle of the bin on [0, 1] after which the variance between the two classes is greatest, the first of equal ones."""
    counts = F.transform(A.histogram(F.transform(voxels, lambda x: A.clip(x)), bins), lambda c: c.cast("double"))
    return A.let(lambda c: A.let(lambda n, m: _otsu(c, n, m, bins), A.total(c), A.total(F.transform(c, lambda x, k: x * (k + 0.5) / bins))), counts)


def _otsu(counts: Column, n: Column, sums: Column, bins: int) -> Column:
    def step(a: Column, x: Column) -> Column:
        w, m = a["w"] + x["c"], a["m"] + x["c"] * (x["k"] + 0.5) / bins
        d = sums * w - m * n
        between = F.when((w > 0) & (w < n), F.round(d * d / (w * (n - w)), 9)).otherwise(0.0)
        better = between > a["best"]
        return F.struct(w.alias("w"), m.alias("m"), F.when(better, between).otherwise(a["best"]).alias("best"), F.when(better, x["k"]).otherwise(a["at"]).alias("at"))

    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("m"), F.lit(0.0).alias("best"), F.lit(0).alias("at"))
    return F.aggregate(F.transform(counts, lambda c, k: F.struct(c.alias("c"), k.alias("k"))), start, step, lambda a: (a["at"] + 0.5) / bins)


#: The names of effects(), in order.
EFFECTS = (
    "mean_abs", "support_mean_abs", "changed", "support_p99_abs", "range_before", "range_after", "range_ratio", "support_floor", "support_low", "support_high", "support_retention",
    "mask_mean_abs", "mask_p99_abs", "rms_ratio", "new_zero", "new_one", "exact_one", "plateau_before", "plateau",
)


def effects(before: Column, after: Column, mask: Column) -> Column:
    """What an operator did: a struct of EFFECTS, which the hard tail's gates read.

    The support is what exceeds a quarter of the first percentile of the
    positives (everything, if nothing does). Null where there is no mask to judge by.
    """
    low = 1e-6

    def judged(rows: Column, floor: Column) -> Column:
        some = F.filter(rows, lambda r: r["x"] > floor)
        return A.let(lambda s, t: found(rows, s, t, floor), F.when(F.size(some) > 0, some).otherwise(rows), F.filter(rows, lambda r: r["m"]))

    def found(rows: Column, s: Column, t: Column, floor: Column) -> Column:
        of = lambda a, k: F.transform(a, lambda r: r[k])
        gap = lambda a: F.transform(a, lambda r: F.abs(r["y"] - r["x"]))
        share = lambda a, test: A.try_divide(F.size(F.filter(a, test)).cast("double"), F.size(a))
        spread = lambda a: A.let(lambda v: A.percentile(v, 95.0) - A.percentile(v, 5.0), a)
        rms = lambda a: F.sqrt(A.mean(F.transform(a, lambda x: x * x)))
        values = {
            "mean_abs": A.mean(gap(rows)), "support_mean_abs": A.mean(gap(s)), "changed": share(rows, lambda r: F.abs(r["y"] - r["x"]) > low), "support_p99_abs": A.percentile(gap(s), 99.0),
            "range_before": spread(of(s, "x")), "range_after": spread(of(s, "y")), "support_floor": floor, "support_low": share(s, lambda r: r["y"] <= low), "support_high": share(s, lambda r: r["y"] >= 1 - low),
            "support_retention": share(s, lambda r: r["y"] > floor), "mask_mean_abs": A.mean(gap(t)), "mask_p99_abs": A.percentile(gap(t), 99.0), "rms_ratio": rms(of(t, "y")) / (rms(of(t, "x")) + 1e-8),
            "new_zero": share(t, lambda r: (r["y"] <= low) & (r["x"] > low)), "new_one": share(t, lambda r: (r["y"] >= 1 - low) & (r["x"] < 1 - low)), "exact_one": share(t, lambda r: r["y"] >= 1 - low),
            "plateau_before": F.when(F.size(t) > 0, plateau_fraction(of(t, "x"))), "plateau": F.when(F.size(t) > 0, plateau_fraction(of(t, "y"))),
        }
        return A.let(lambda a, b: F.struct(*[(b / (a + 1e-8) if k == "range_ratio" else a if k == "range_before" else b if k == "range_after" else values[k]).alias(k) for k in EFFECTS]), values["range_before"], values["range_after"])

    rows = F.arrays_zip(before.alias("x"), after.alias("y"), mask.alias("m"))
    floor = F.greatest(F.lit(low), F.coalesce(A.percentile(A.positives(before), 1.0) * 0.25, F.lit(low)))
    return A.let(judged, rows, floor)


def raised_floor(before: Column, after: Column) -> Column:
    """The volume after, where positives that fell to 0 get 1 % of what they were (2e-6 at least)."""
    return F.zip_with(before, after, lambda x, y: F.when((x > 1e-6) & (y <= 1e-6), F.greatest(F.lit(2e-6), 0.01 * x)).otherwise(y))


def floor_share(before: Column, after: Column) -> Column:
    """The share of the positives that fell to 0."""
    gone = F.size(F.filter(F.zip_with(before, after, lambda x, y: (x > 1e-6) & (y <= 1e-6)), lambda t: t))
    return gone / F.greatest(F.lit(1), F.size(F.filter(before, lambda x: x > 1e-6))).cast("double")


def lag_correlation(v: ColumnVolume, axis: int, lag: int = 1, least: int = 64) -> Column:
    """Pearson correlation of voxels with their neighbour `lag` further; 0 for fewer than `least` pairs or flat ones."""

    def pair(x: Column, idx: Column) -> Column:
        place = list(v.ijk(idx))
        inside = place[axis] + lag < v.size(axis)
        place[axis] = F.least(place[axis] + lag, v.size(axis) - 1)
        return F.when(inside, F.struct(x.alias("x"), v.at(*place).alias("y")))

    def moments(pairs: Column, mx: Column, my: Column) -> Column:
        sums = [A.total(F.transform(pairs, f)) for f in (lambda p: (p["x"] - mx) * (p["y"] - my), lambda p: (p["x"] - mx) * (p["x"] - mx), lambda p: (p["y"] - my) * (p["y"] - my))]
        return A.let(lambda cov, sx, sy: F.when((F.size(pairs) < least) | (sx * sy < 1e-18), 0.0).otherwise(cov / F.sqrt(sx * sy)), *sums)

    pairs = F.filter(F.transform(v.voxels, pair), lambda p: p.isNotNull())
    return A.let(lambda p: A.let(lambda mx, my: moments(p, mx, my), A.mean(F.transform(p, lambda q: q["x"])), A.mean(F.transform(p, lambda q: q["y"]))), pairs)


def bounding_box(v: ColumnVolume) -> Column:
    """struct(low, high, centroid, n) of the mask's true voxels; nulls if there are none."""
    at = F.filter(F.transform(v.mask, lambda m, idx: F.when(m, idx)), lambda i: i.isNotNull())
    return A.let(lambda a: _box(v, a), at)


def _box(v: ColumnVolume, at: Column) -> Column:
    places = [F.transform(at, _axis(v, a)) for a in range(3)]
    return F.struct(
        F.array(*[F.array_min(p) for p in places]).alias("low"), F.array(*[F.array_max(p) for p in places]).alias("high"),
        F.array(*[A.mean(F.transform(p, lambda x: x.cast("double"))) for p in places]).alias("centroid"), F.size(at).alias("n"),
    )


def _axis(v: ColumnVolume, a: int):
    return lambda i: v.ijk(i)[a]


def top_fraction(score: Column, share: float) -> Column:
    """Booleans of the ceil(share * n) greatest values, one at least; ties by the lower index."""
    keep = F.greatest(F.lit(1), F.ceil(share * F.size(score)).cast("int"))
    order = F.array_sort(F.transform(score, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    chosen = F.transform(F.slice(order, 1, keep), lambda s: s["i"])
    return A.let(lambda c: F.transform(score, lambda _, i: F.array_contains(c, i)), chosen)


def tone_map(voxels: Column, gamma: float, knots: list[float], contrast: float, brightness: float) -> Column:
    """Power, then linear interpolation through equally spaced knots, then contrast about 0.5 and brightness, clipped."""
    n = len(knots) - 1

    def one(x: Column) -> Column:
        t = F.pow(A.clip(x), F.lit(gamma)) * n
        out = F.when(t <= 0, F.lit(float(knots[0])))
        for k in range(n):
            out = out.when(t <= k + 1, knots[k] + (t - k) * (knots[k + 1] - knots[k]))
        return A.clip((out.otherwise(F.lit(float(knots[-1]))) - 0.5) * contrast + 0.5 + brightness)

    return F.transform(voxels, one)


def quantile_transfer(voxels: Column, donor: Column, points: int = 256, least: int = 8) -> Column:
    """Positive values to the donor's quantiles, by linear interpolation between `points` of them; 0 stays 0,
    and too few positives on either side leave all as is."""
    places = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: k * (100.0 / (points - 1)))

    def one(x: Column, a: Column, b: Column) -> Column:
        below = F.size(F.filter(a, lambda q: q <= x))
        low = F.greatest(F.least(below, F.lit(points - 1)), F.lit(1))
        x0, x1, y0, y1 = F.get(a, low - 1), F.get(a, low), F.get(b, low - 1), F.get(b, low)
        inner = F.when(x1 > x0, y0 + (y1 - y0) * A.clip((x - x0) / (x1 - x0))).otherwise(y1)
        return F.when(x > 0, inner).otherwise(0.0)

    def run(own: Column, other: Column) -> Column:
        knots = [F.transform(places, lambda q: A.percentile(own, q)), F.transform(places, lambda q: A.percentile(other, q))]
        mapped = A.let(lambda a, b: F.transform(voxels, lambda x: one(x, a, b)), *knots)
        return F.when((F.size(own) >= least) & (F.size(other) >= least), mapped).otherwise(voxels)

    return A.let(run, F.array_sort(A.positives(voxels)), F.array_sort(A.positives(donor)))
