"""Confusion counts and overlap scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import try_divide


def confusion(prediction: Column, reference: Column) -> Column:
    """struct(tp, fp, fn, tn) of two boolean arrays of equal length."""
    zero = F.struct(*[F.lit(0).cast("long").alias(k) for k in ("tp", "fp", "fn", "tn")])
    pairs = F.zip_with(prediction, reference, lambda p, r: F.struct(p.alias("p"), r.alias("r")))

    def step(s: Column, x: Column) -> Column:
        p, r = x["p"], x["r"]
        return F.struct(*[(s[k] + hit.cast("long")).alias(k) for k, hit in (("tp", p & r), ("fp", p & ~r), ("fn", ~p & r), ("tn", ~p & ~r))])

    return F.aggregate(pairs, zero, step)


def dice(tp: Column, fp: Column, fn: Column) -> Column:
    """1 if both masks are empty."""
    return F.coalesce(try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(1.0))


def iou(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(try_divide(tp.cast("double"), tp + fp + fn), F.lit(1.0))


def precision(tp: Column, fp: Column) -> Column:
    """Null if nothing was predicted."""
    return try_divide(tp.cast("double"), tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    """Null if the reference is empty."""
    return try_divide(tp.cast("double"), tp + fn)


def smoothed_dice(tp: Column, fp: Column, fn: Column, eps: float = 1e-6) -> Column:
    return (2.0 * tp + eps) / (2 * tp + fp + fn + eps)


def tversky_loss(probability: Column, target: Column, alpha: float = 0.3, beta: float = 0.7, eps: float = 1e-6) -> Column:
    """1 - soft Tversky index; alpha weighs false positives, beta misses."""
    pairs = F.zip_with(probability, target, lambda p, t: F.struct(p.alias("p"), t.cast("double").alias("t")))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in "abc"])
    sums = F.aggregate(pairs, zero, lambda s, x: F.struct((s["a"] + x["p"] * x["t"]).alias("a"), (s["b"] + x["p"] * (1 - x["t"])).alias("b"), (s["c"] + (1 - x["p"]) * x["t"]).alias("c")))
    return 1.0 - (sums["a"] + eps) / (sums["a"] + alpha * sums["b"] + beta * sums["c"] + eps)


def bce_loss(logit: Column, target: Column, positive_weight: float = 1.0) -> Column:
    """Mean binary cross-entropy on logits, in the form that doesn't overflow."""

    def one(z: Column, t: Column) -> Column:
        t = t.cast("double")
        soft = F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))
        return (1 - t) * z + (1 + (positive_weight - 1) * t) * soft

    terms = F.zip_with(logit, target, one)
    return try_divide(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.size(terms))


def sigmoid(z: Column) -> Column:
    """The logistic function, its argument held to +-30."""
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def _mean(terms: Column) -> Column:
    return try_divide(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.size(terms))


def boundary_loss(logit: Column, distance: Column) -> Column:
    """Mean of the probability times the signed distance (positive outside): what lies far outside costs most."""
    return _mean(F.zip_with(logit, distance, lambda z, d: sigmoid(z) * d))


def boundary_focal_loss(logit: Column, target: Column, band: Column, positive_weight: float = 2.5, gamma: float = 2.0) -> Column:
    """Focal cross-entropy over the boundary band, by its own count; 0 without a band."""

    def one(s: Column) -> Column:
        z, t = s["z"], s["t"].cast("double")
        soft = F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))
        cost = (1 - t) * z + (1 + (positive_weight - 1) * t) * soft
        hit = t * sigmoid(z) + (1 - t) * (1 - sigmoid(z))
        return F.pow(F.greatest(1 - hit, F.lit(0.0)), F.lit(gamma)) * cost

    rows = F.arrays_zip(logit.alias("z"), target.alias("t"), band.alias("b"))
    return F.coalesce(_mean(F.transform(F.filter(rows, lambda s: s["b"]), one)), F.lit(0.0))


def clipped_distance_loss(predicted: Column, distance: Column, band: float = 5.0, far_weight: float = 0.1) -> Column:
    """Mean squared error against the signed distance (positive inside), clipped to +-band; clipped voxels weigh less."""

    def one(p: Column, d: Column) -> Column:
        t = F.least(F.greatest(d, F.lit(-band)), F.lit(band))
        return F.when(F.abs(d) >= band, far_weight).otherwise(1.0) * (p - t) * (p - t)

    return _mean(F.zip_with(predicted, distance, one))


def deep_supervision(losses: list[Column]) -> Column:
    """Heads from the finest on, each weighing half as much as the one before, by the sum of the weights."""
    weights = [0.5**k for k in range(len(losses))]
    return sum((w * x for w, x in zip(weights, losses, strict=True)), F.lit(0.0)) / sum(weights)


def regional_dice(prediction: Column, target: Column, inside: Column, eps: float = 1e-6) -> Column:
    """Smoothed Dice over the voxels that `inside` marks."""
    rows = F.filter(F.arrays_zip(prediction.alias("p"), target.alias("t"), inside.alias("i")), lambda s: s["i"])
    count = lambda test: F.size(F.filter(rows, test))
    both, p, t = count(lambda s: s["p"] & s["t"]), count(lambda s: s["p"]), count(lambda s: s["t"])
    return (2.0 * both + eps) / (p + t + eps)
