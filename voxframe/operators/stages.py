"""Pipeline stages: compositions of operators with keyed choices.

Voxels are bound along with the draws, so that a kernel that made them stays outside of lambdas, where Spark can run it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import draws
from ..plans.acquisition import acquisition
from ..plans.routing import HARD_PROFILES, HARD_SEVERITIES, NEW_ZERO_CAPS, STRONG_DIMMERS, hard_tail_verdict, route_default
from .measures import EFFECTS, effects, floor_share, lag_correlation, raised_floor, robust_sigma, tone_map
from . import primitives as P
from .registry import OPERATORS, ColumnVolume, apply_chosen, apply_operator, case_rng, with_pandas

# Targets (csf, gm, wm) and extracranial factor of the sequences; noise, bias and contrast of the fields.
SEQUENCES = {
    "MPRAGE": (0.12, 0.45, 0.75, 0.85), "MP2RAGE": (0.12, 0.42, 0.70, 0.55), "SPGR": (0.28, 0.46, 0.62, 0.85), "TSE_T2": (0.90, 0.44, 0.24, 0.80), "SPACE_T2": (0.88, 0.44, 0.24, 0.78),
    "FLAIR": (0.07, 0.62, 0.48, 0.55), "STIR": (0.90, 0.60, 0.42, 0.05), "DIR": (0.10, 0.74, 0.14, 0.40), "PSIR": (0.15, 0.32, 0.85, 0.60), "GRE_SWI": (0.30, 0.52, 0.58, 0.60),
}
FIELDS = {0.064: (0.10, 0.12, 0.85), 0.55: (0.060, 0.20, 0.92), 1.5: (0.030, 0.30, 1.00), 3.0: (0.018, 0.45, 1.00), 5.0: (0.015, 0.65, 1.02), 7.0: (0.013, 0.85, 1.05), 9.4: (0.012, 1.00, 1.07), 10.5: (0.011, 1.10, 1.08), 11.7: (0.011, 1.20, 1.10)}
RECON_NOISE = {"none": 1.0, "GRAPPA": 1.25, "SENSE": 1.35, "SMS": 1.20, "CompressedSensing": 0.70, "DLRecon": 0.40}


def _volume(name: str, seed: int) -> ColumnVolume:
    return ColumnVolume(F.col("voxels"), F.col("mask"), F.col("shape"), F.col("case_id").cast("string"), seed, name)


def bias_field(df: DataFrame, seed: int, order: int = 3, strength: float | Column = 0.5) -> DataFrame:
    """The exponential of a random sum of low cosines without the constant one, its exponent held to 1.2."""
    v = _volume("realistic_bias_field", seed)
    terms = [(a, b, c) for a in range(order) for b in range(order) for c in range(order) if a + b + c]
    weights = [v.between(-1.0, 1.0, *t) * strength / math.sqrt(len(terms)) for t in terms]

    def field(voxels: Column, *bound: Column) -> Column:
        def one(x: Column, *place: Column) -> Column:
            total = F.lit(0.0)
            for w, t in zip(bound, terms, strict=True):
                wave = w
                for p, n, axis in zip(place, t, range(3), strict=True):
                    if n:
                        wave = wave * F.cos(math.pi * n * (p + 0.5) / v.size(axis))
                total = total + wave
            return x * F.exp(A.clip(total, -1.2, 1.2))

        return replace(v, voxels=voxels).map(one)

    return df.withColumn("voxels", A.let(field, F.col("voxels"), *weights))


def additive_noise(df: DataFrame, seed: int, most: float | Column = 0.05) -> DataFrame:
    """Normal noise of a deviation drawn for each case, `most` at most."""
    v = _volume("realistic_noise", seed)
    return df.withColumn("voxels", A.let(lambda voxels, sigma: F.transform(voxels, lambda x, i: x + sigma * v.normal("n", i)), F.col("voxels"), v.uniform("sigma") * most))


def tone_mapping(df: DataFrame, seed: int, gamma=(0.7, 1.5), contrast=(0.8, 1.3), brightness=(-0.1, 0.1), jitter: float = 0.22) -> DataFrame:
    """Power, a monotone curve through six jittered knots (the first stays 0), contrast about 0.5 and brightness, all drawn for each case; clipped."""
    v = _volume("tone_mapping", seed)
    knots = F.array_sort(F.array(*[k / 5.0 + v.between(-jitter, jitter, "knot", k) for k in range(6)]))
    knots = F.transform(knots, lambda y, k: F.when(k == 0, 0.0).otherwise(A.clip(y, 0.0, 1.15)))

    def curve(voxels: Column, ys: Column, g: Column, c: Column, b: Column) -> Column:
        def one(x: Column) -> Column:
            t = F.pow(A.clip(x), g) * 5
            k = F.least(F.floor(t).cast("int"), F.lit(4))
            y = F.get(ys, k) + (t - k) * (F.get(ys, k + 1) - F.get(ys, k))
            return A.clip(0.5 + c * (y - 0.5) + b)

        return F.transform(voxels, one)

    return df.withColumn("voxels", A.let(curve, F.col("voxels"), knots, v.between(*gamma, "gamma"), v.between(*contrast, "contrast"), v.between(*brightness, "brightness")))


def resolution(df: DataFrame, seed: int, share: float = 0.6, most: float = 2.2, factors: tuple[float, float, float] | None = None) -> DataFrame:
    """Each axis, with the given chance, blurred by a third of a factor up to `most`, made coarser by it and brought back."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for case, voxels, shape in zip(pdf["case_id"].astype(str), pdf["voxels"], pdf["shape"], strict=True):
            x, rng = np.asarray(voxels, float).reshape([int(n) for n in shape]), case_rng(seed, case, "resolution")
            f = factors or [rng.uniform(1.0, most) if rng.random() < share else 1.0 for _ in range(3)]
            small = P.resize(P.gaussian(x, [k / 3 if k > 1 else 0.0 for k in f]), [max(1, round(n / k)) for n, k in zip(x.shape, f, strict=True)])
            out.append(P.resize(small, x.shape).ravel())
        return pdf.assign(voxels=out)

    return with_pandas(df, run)


def render_sequence(df: DataFrame, sequence: Column, field: float | Column = 3.0, clean: bool = True, recon: str | Column = "none", seed: int = 0) -> DataFrame:
    """Tissue by terciles of the mask remapped to a sequence's targets, others scaled; then bias and noise of the field
    (halved if clean) and of the reconstruction. Field and reconstruction may be columns."""
    look = F.create_map(*[x for k, t in FIELDS.items() for x in (F.lit(float(k)), F.array(*map(F.lit, map(float, t))))])[F.lit(field) if isinstance(field, float) else field]
    gain = F.create_map(*[F.lit(x) for k, t in RECON_NOISE.items() for x in (k, t)])[F.lit(recon) if isinstance(recon, str) else recon]
    table = F.create_map(*[x for k, t in SEQUENCES.items() for x in (F.lit(k), F.array(*map(F.lit, t)))])
    inside = A.where(F.col("voxels"), F.col("mask"), lambda x, m: m)

    def remap(pairs: Column, t: Column, low: Column, high: Column, contrast: Column) -> Column:
        def one(p: Column) -> Column:
            x = p["x"]
            tissue = F.when(x < low, t[0]).when(x < high, t[1]).otherwise(t[2])
            return A.clip(F.when(p["m"], 0.5 + contrast * (0.8 * tissue + 0.2 * x - 0.5)).otherwise(x * t[3]))

        return F.transform(pairs, one)

    zipped = F.arrays_zip(F.col("voxels").alias("x"), F.col("mask").alias("m"))
    out = df.withColumn("voxels", A.let(remap, zipped, table[sequence], A.percentile(inside, 33.0), A.percentile(inside, 67.0), look[2]))
    half = 0.5 if clean else 1.0
    return additive_noise(bias_field(out, seed, strength=look[1] * half), seed, look[0] * gain * (2 * half))


def realistic_acquisition(df: DataFrame, seed: int, share: float = 0.55) -> DataFrame:
    """In `share` of the cases a scan as another machine would make it: field, sequence, vendor and reconstruction drawn together
    and rendered; other cases stay. Adds `acquisition`, null where nothing was drawn."""
    case = F.col("case_id").cast("string")
    rows = df.withColumns({"acquisition": F.when(draws.uniform(seed, case, "acquire") < share, acquisition(seed, case)), "_before": F.col("voxels")})
    out = render_sequence(rows, F.col("acquisition.sequence"), F.col("acquisition.field"), False, F.col("acquisition.recon"), seed)
    return out.withColumn("voxels", F.when(F.col("acquisition").isNotNull(), F.transform("voxels", lambda x: A.clip(x))).otherwise(F.col("_before"))).drop("_before")


def style_descriptor(df: DataFrame, sigmas: tuple[float, ...] = (0.6, 1.2, 2.4), quantiles: int = 33, least: int = 64) -> DataFrame:
    """Adds `residual_scales` (robust deviations of what a Gaussian of each sigma takes away, in the mask), `lags` (correlations
    at one and two voxels along each axis of the finest residual) and `cdf` (equally spaced quantiles in the mask)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [np.asarray(x, float).reshape([int(n) for n in s]) for x, s in zip(pdf["voxels"], pdf["shape"], strict=True)]
        return pdf.assign(_residuals=[[(x - P.gaussian(x, sigma)).ravel().tolist() for sigma in sigmas] for x in rows])

    out = with_pandas(df, run, "_residuals array<array<double>>")
    mask = F.transform("mask", lambda m: m.cast("boolean"))
    inside = lambda a: A.where(a, mask, lambda x, m: m)
    finest = ColumnVolume(F.get("_residuals", 0), F.col("mask"), F.col("shape"), F.lit(""), 0, "")
    scales = F.array(*[robust_sigma(inside(F.get("_residuals", k))) for k in range(len(sigmas))])
    lags = F.array(*[lag_correlation(finest, axis, lag, least) for lag in (1, 2) for axis in range(3)])
    cdf = A.let(lambda s: F.array(*[A.percentile(s, 100.0 * k / (quantiles - 1)) for k in range(quantiles)]), F.array_sort(inside(F.col("voxels"))))
    return out.withColumns({"residual_scales": scales, "lags": lags, "cdf": cdf}).drop("_residuals")


def appearance(df: DataFrame, seed: int) -> DataFrame:
    """Tone, bias, resolution and noise."""
    toned = df.withColumn("voxels", tone_map(F.col("voxels"), 1.1, [0.0, 0.18, 0.42, 0.6, 0.83, 1.0], 1.05, 0.02))
    coarse = apply_operator(bias_field(toned, seed), "randomize_resolution", 0.35, seed)
    return additive_noise(coarse, seed)


#: The severity of pool operators that have no training range of their own.
OVERLAY_SEVERITY = (0.3, 0.85)


def apply_pool(df: DataFrame, chosen: Column, seed: int, severity: tuple[float, float] = OVERLAY_SEVERITY, errors: str | None = None) -> DataFrame:
    """The pool operator that `chosen` names, within its training range, clipped; a value that isn't finite is an error, as apply_chosen() has them."""
    rows = apply_chosen(df, chosen, {n: tuple(o.train or severity) for n, o in OPERATORS.items() if o.pool}, seed, errors)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    text = "an operator gave a value that isn't finite"
    if errors:
        rows = rows.withColumn(errors, F.coalesce(F.col(errors), F.when(F.exists("voxels", bad), text)))
        return rows.withColumn("voxels", F.transform("voxels", lambda x: A.clip(x)))
    return rows.withColumn("voxels", F.transform("voxels", lambda x: F.when(bad(x), F.raise_error(F.lit(text))).otherwise(A.clip(x))))


def two_of_pool(names: Column, draw: Callable[[Column], Column]) -> Column:
    """The two names of the least draws, ties by name; the second is no strong dimmer if the first is one.

    Each name is drawn for once a row, and no more is sorted out than the least of them.
    """
    dim = lambda n: n.isin(*STRONG_DIMMERS)

    def pick(entries: Column) -> Column:
        def after(first: Column) -> Column:
            fits = lambda e: (e["n"] != first) & ~(dim(first) & dim(e["n"]))
            return F.array(first, F.array_min(F.filter(entries, fits))["n"])

        return A.let(after, F.array_min(entries)["n"])

    return A.let(pick, F.transform(names, lambda n: F.struct(draw(n).alias("u"), n.alias("n"))))


def overlay(df: DataFrame, seed: int, severity: tuple[float, float] = OVERLAY_SEVERITY, without: Column | None = None) -> DataFrame:
    """One or two distinct pool operators, none of the array `without`, for each case, at most one of the strong dimmers, each clipped; adds `artifacts`.

    Operators are chosen by keyed draws. An operator that fails, or gives values
    that aren't finite, fails the query.
    """
    pool = [n for n, o in OPERATORS.items() if o.pool]
    names = F.array(*map(F.lit, pool))
    names = names if without is None else F.array_except(names, without)
    case = F.col("case_id").cast("string")
    count = F.when(draws.uniform(seed, case, "count") < 0.5, 1).otherwise(2)
    rows = df.withColumn("artifacts", A.let(lambda two: F.slice(two, 1, count), two_of_pool(names, lambda n: draws.uniform(seed, case, n))))
    for turn in range(2):
        rows = apply_pool(rows, F.get(F.col("artifacts"), turn), seed + turn, severity)
    return rows


def judged(df: DataFrame, before: str, after: str, profile: Column, step_abs: Column) -> DataFrame:
    """Rows with `after` raised from 0 where it was positive, the effects as columns, and the `verdict` of the hard tail's gates."""
    zero_cap = F.coalesce(F.create_map(*[F.lit(x) for k, v in NEW_ZERO_CAPS.items() for x in (k, v)])[profile], F.lit(0.01))
    inside = F.transform("mask", lambda m: m.cast("boolean"))
    gone = A.where(F.zip_with(before, after, lambda x, y: ((x > 1e-6) & (y <= 1e-6)).cast("double")), inside, lambda _, m: m)
    raw = {"step_abs": step_abs, "zero_cap": zero_cap, "floor_share": floor_share(F.col(before), F.col(after)), "raw_new_zero": A.mean(gone)}
    rows = df.withColumns(raw).withColumn(after, raised_floor(F.col(before), F.col(after)))
    rows = rows.withColumn("_effects", effects(F.col(before), F.col(after), inside))
    return rows.withColumns({k: F.col(f"_effects.{k}") for k in EFFECTS}).drop("_effects").withColumn("verdict", hard_tail_verdict())


def hard_tail(df: DataFrame, seed: int) -> DataFrame:
    """Each case under one of the hard profiles, two operators in turn, if the gates accept what they did; else as it was. Adds `profile` and `verdict`.

    Operators don't see the mask, which only the gates read; an operator's error fails the query.
    """
    case = F.col("case_id").cast("string")
    profile = draws.choice(draws.uniform(seed, case, "profile"), {k: 1.0 for k in HARD_PROFILES})
    own = F.transform("voxels", lambda x: x.cast("double"))
    rows = df.withColumns({"profile": profile, "voxels": own}).withColumns({"_before": F.col("voxels"), "_mask": F.col("mask"), "_step": F.lit(float("inf"))})
    rows = rows.withColumn("mask", F.transform("voxels", lambda x: x > 0))
    for turn in range(2):
        names = F.create_map(*[F.lit(x) for k, ops in HARD_PROFILES.items() for x in (k, ops[turn])])
        rows = rows.withColumn("_last", F.col("voxels"))
        rows = apply_chosen(rows, names[F.col("profile")], {ops[turn]: HARD_SEVERITIES[k][turn] for k, ops in HARD_PROFILES.items()}, seed + turn)
        rows = rows.withColumn("voxels", F.transform("voxels", lambda x: A.clip(x)))
        rows = rows.withColumn("_step", F.least("_step", A.mean(F.zip_with("voxels", "_last", lambda a, b: F.abs(a - b)))))
    done = judged(rows.withColumn("mask", F.col("_mask")), "_before", "voxels", F.col("profile"), F.col("_step"))
    out = done.withColumn("voxels", F.when(F.col("verdict") == "accept", F.col("voxels")).otherwise(F.col("_before")))
    return out.select(*df.columns, "profile", "verdict")


def routed(df: DataFrame, seed: int) -> DataFrame:
    """Each case with the branch that its draw takes in the default router."""
    return df.withColumn("route", route_default(draws.uniform(seed, F.col("case_id").cast("string"), "route")))
