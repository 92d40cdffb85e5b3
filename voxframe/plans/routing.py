"""Where a sample goes: functions of one uniform draw and of the policy's shares."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.draws import choice

#: Default shares of the router.
DEFAULT = {"clean": 0.18, "standard": 0.22, "benign": 0.30, "label_synthesis": 0.30}
MIXED_REST = {"clean": 0.15, "standard": 0.15, "benign": 0.35, "label_synthesis": 0.35}
BENIGN_REST = {"clean": 0.25, "standard": 0.25, "benign": 0.50}
#: Hard-tail profiles, each of two operators.
HARD_PROFILES = {"motion_gibbs": ("gibbs", "motion"), "ghost_rician": ("ghosting", "rician_noise"), "undersample_recon": ("pe_undersample", "dl_recon"), "bias_erasing": ("bias", "random_erasing"), "alias_gfactor": ("aliasing", "g_factor_noise")}
#: The severities of each profile's operators.
HARD_SEVERITIES = {"motion_gibbs": ((0.38, 0.44), (0.10, 0.20)), "ghost_rician": ((0.70, 0.95), (0.25, 0.45)), "undersample_recon": ((0.70, 1.00), (0.40, 0.65)), "bias_erasing": ((0.50, 0.75), (0.65, 0.90)), "alias_gfactor": ((0.65, 0.90), (0.18, 0.30))}
#: The phenotypes of the posterior package and their weights.
POSTERIOR_PHENOTYPES = {"sharp_balanced": 0.20, "sharp_grainy_exterior": 0.15, "dark_nonstationary_texture": 0.25, "vague_low_snr": 0.30, "directed_fn_adversary": 0.10}
#: Operators of which a case gets one at most.
STRONG_DIMMERS = ("dropout", "signal_drop_band", "bounce_point_null", "void", "metal_void")


@dataclass(frozen=True)
class Policy:
    """None is not 0: an absent share leaves the router as it is, a zero one takes part in it."""

    benign_fraction: float | None = None
    mixed_fraction: float | None = None
    conditional: tuple[tuple[str, float], ...] = ()
    target_style: float | None = None
    hard_tail: float | None = None

    def __post_init__(self) -> None:
        for f in (self.benign_fraction, self.mixed_fraction, self.target_style, self.hard_tail, *(s for _, s in self.conditional)):
            if f is not None and not (math.isfinite(f) and 0 <= f <= 1):
                raise ValueError(f"{f} is not a share")
        if self.benign_fraction is not None and self.mixed_fraction is not None:
            raise ValueError("benign and mixed fractions exclude each other")
        if math.fsum([s for _, s in self.conditional] + [self.target_style or 0.0]) > 1 + 1e-12:
            raise ValueError("conditional shares exceed 1")
        exposed = self.benign_fraction or self.mixed_fraction or 0.0
        if self.target_style and (self.target_style > 0.10 or self.target_style * exposed > 0.035):
            raise ValueError("too much target style")
        if self.hard_tail and (self.hard_tail > 0.10 or self.hard_tail * (1 - exposed) > 0.05):
            raise ValueError("too much hard tail")


def route_default(draw: Column) -> Column:
    return choice(draw, DEFAULT)


def route(draw: Column, policy: Policy) -> Column:
    """With a dedicated fraction: below it the MP2RAGE branch, above it the rest by a renormalised draw."""
    fraction = policy.mixed_fraction if policy.mixed_fraction is not None else policy.benign_fraction
    if fraction is None:
        return route_default(draw)
    rest = MIXED_REST if policy.mixed_fraction is not None else BENIGN_REST
    if fraction >= 1:
        return F.lit("mp2rage")
    return F.when(draw < fraction, "mp2rage").otherwise(choice((draw - fraction) / (1 - fraction), rest))


def route_mp2rage(draw: Column, policy: Policy) -> Column:
    """Inside the branch: the explicit shares in order, a clean anchor of 0.10 or what is left, the ordinary look."""
    shares = dict(policy.conditional)
    if policy.target_style is not None:
        shares["target_style"] = policy.target_style
    left = max(0.0, 1 - math.fsum(shares.values()))
    anchor = min(0.10, left)
    return choice(draw, shares | {"clean_anchor": anchor, "ordinary": max(0.0, left - anchor)})


def hard_tail_gate(draw: Column, hard: float, dedicated: float) -> Column:
    """hard; else dedicated with (1 - hard) * dedicated; else other."""
    return choice(draw, {"hard_tail": hard, "dedicated": (1 - hard) * dedicated, "other": (1 - hard) * (1 - dedicated)})


def curriculum_ramp(epoch: Column, start: int = 5, ramp: int = 20, steps: int = 2) -> tuple[Column, Column]:
    """Progress in [0, 1] from the start epoch on, and the number of attack steps."""
    progress = F.when(epoch < start, 0.0).otherwise(F.least(F.lit(1.0), (epoch - start + 1) / float(ramp)))
    return progress, F.ceil(progress * steps).cast("int")


def lr_schedule(step: Column, warmup: int, total: int, base: float, floor: float = 0.0) -> Column:
    """Linear from a tenth of the base rate, then a cosine down to the floor."""
    warm = base * (0.1 + 0.9 * step / float(max(1, warmup)))
    t = F.least(F.lit(1.0), (step - warmup) / float(max(1, total - warmup)))
    return F.when(step < warmup, warm).otherwise(floor + 0.5 * (base - floor) * (1 + F.cos(math.pi * t)))


def faithful(kind: Column, category: Column) -> Column:
    """Whether a drawn kind may stand for a validation category."""
    return (
        F.when(kind == "clean_geometry_fallback", False)
        .when(category.startswith("posterior"), kind == category)
        .when(category == "nonbenign", kind.contains("+"))
        .otherwise(True)
    )


def splitmix64(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


def batch_gate(seed: int, epoch: int, batch: int, size: int, fraction: float) -> bool:
    """A stateless coin for a batch: 53 bits of a mix of its coordinates, below the fraction."""
    mixed = splitmix64(seed)
    for k, v in enumerate((epoch, batch, size)):
        mixed = splitmix64(mixed ^ splitmix64(v + k + 1))
    return (mixed >> 11) / 2**53 < fraction


def _decimal(n: int) -> Column:
    return F.lit(Decimal(n))


def _affine64(v: Column, factor: int, plus: int) -> Column:
    """v * factor + plus modulo 2**64 of a BIGINT's bits, in decimals, since a BIGINT doesn't wrap."""
    word, half = _decimal(1 << 64), _decimal(1 << 32)
    low, high = v.bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(10,0)"), F.shiftrightunsigned(v, 32).cast("decimal(10,0)")
    cross = ((low * _decimal(factor >> 32) + high * _decimal(factor & 0xFFFFFFFF)) % half).cast("decimal(10,0)")
    total = ((low * _decimal(factor & 0xFFFFFFFF) + cross * half + _decimal(plus)) % word).cast("decimal(20,0)")
    return let(lambda t: F.when(t >= _decimal(1 << 63), t - word).otherwise(t).cast("long"), total)


def splitmix64_column(x: Column) -> Column:
    """splitmix64() of a BIGINT's bits."""

    def shaken(shift: int):
        return lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, shift))

    v = let(shaken(30), let(lambda a: _affine64(a, 1, 0x9E3779B97F4A7C15), x))
    v = let(shaken(27), let(lambda a: _affine64(a, 0xBF58476D1CE4E5B9, 0), v))
    return let(shaken(31), let(lambda a: _affine64(a, 0x94D049BB133111EB, 0), v))


def with_batch_gate(df: DataFrame, seed: int, epoch: str, batch: str, size: str, fraction: float, name: str = "attacked") -> DataFrame:
    """batch_gate() of each row's columns, one step at a time so that no expression nests all of them."""
    first = splitmix64(seed)
    df = df.withColumn("_mixed", F.lit(first - (1 << 64) if first >= 1 << 63 else first).cast("long"))
    for k, v in enumerate((epoch, batch, size)):
        df = df.withColumn("_own", splitmix64_column(F.col(v).cast("long") + k + 1))
        df = df.withColumn("_mixed", splitmix64_column(F.col("_mixed").bitwiseXOR(F.col("_own"))))
    return df.withColumn(name, F.shiftrightunsigned("_mixed", 11) / float(2**53) < fraction).drop("_mixed", "_own")


#: The new zeros that a profile may make in the mask, where it isn't 0.01.
NEW_ZERO_CAPS = {"bias_erasing": 0.15}
#: The gates of the hard tail in order, first match wins: (name, condition in SQL over measures.EFFECTS,
#: the steps' least mean change `step_abs`, `floor_share`, `raw_new_zero` and the profile's `zero_cap`).
VETOES = (
    ("operator_noop", "step_abs <= 1e-8"), ("positive_magnitude_floor_fraction", "floor_share > 0.02"), ("raw_new_zero_saturation", "raw_new_zero > zero_cap"),
    ("insufficient_effect", "changed < 1e-3 OR mean_abs < 5e-4 OR support_mean_abs < 1e-3 OR mask_mean_abs < 1e-3 OR mask_p99_abs < 0.02"),
    ("supported_dynamic_range", "NOT range_ratio BETWEEN 0.35 AND 5"), ("in_mask_rms", "NOT rms_ratio BETWEEN 0.25 AND 5"), ("new_zero_saturation", "new_zero > zero_cap"), ("new_one_saturation", "new_one > 0.08"),
    ("exact_one_saturation", "exact_one > 0.10"), ("in_mask_plateau", "plateau > 0.20"), ("support_floor_retention", "support_retention < 0.65"), ("no_mask", "mask_mean_abs IS NULL"),
)


def hard_tail_verdict() -> Column:
    out = None
    for name, sql in VETOES:
        out = F.when(F.expr(sql), name) if out is None else out.when(F.expr(sql), name)
    return out.otherwise("accept")
