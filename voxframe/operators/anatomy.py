"""Kernels that move anatomy: paired poses in millimetres, smooth warps with guards, label maps and their painting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import primitives as P
from .registry import by_shape, case_rng, with_pandas


def rotation(degrees) -> np.ndarray:
    """Rotations about the three axes in turn."""
    out = np.eye(3)
    for axis, d in enumerate(degrees):
        c, s = np.cos(np.radians(d)), np.sin(np.radians(d))
        turn = np.eye(3)
        a, b = [k for k in range(3) if k != axis]
        turn[a, a], turn[a, b], turn[b, a], turn[b, b] = c, -s, s, c
        out = turn @ out
    return out


def poses(xs: np.ndarray, masks: np.ndarray, moves: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """pose() of each scan and mask of a stack by its own parameters."""
    shape = xs.shape[1:]
    middle, g = (np.array(shape, float) - 1).reshape(3, 1) / 2, P.grid(shape).reshape(3, -1)

    def places(degrees=(0.0, 0.0, 0.0), scale=1.0, spacing=(1.0, 1.0, 1.0), shift=(0.0, 0.0, 0.0)) -> np.ndarray:
        to_mm = np.diag(np.asarray(spacing, float))
        back = np.linalg.inv(to_mm) @ np.linalg.inv(rotation(degrees) * scale) @ to_mm
        return back @ (g - middle - (np.asarray(shift, float) / np.asarray(spacing, float)).reshape(3, 1)) + middle

    at = np.stack([places(**m) for m in moves], axis=1)
    at = np.where(np.abs(at - np.rint(at)) < 1e-9, np.rint(at), at).reshape(3, len(xs), *shape)
    limits = np.array(shape).reshape(3, 1, 1, 1, 1) - 1
    inside = ((at >= 0) & (at <= limits)).all(axis=0)
    at = np.clip(at, 0, limits)
    return np.where(inside, P.samples(xs, at), 0.0), (P.samples(masks.astype(float), at, True) > 0.5) & inside


def pose(x: np.ndarray, mask: np.ndarray, degrees=(0.0, 0.0, 0.0), scale=1.0, spacing=(1.0, 1.0, 1.0), shift=(0.0, 0.0, 0.0)) -> tuple[np.ndarray, np.ndarray]:
    """Scan (linear) and mask (nearest) turned, scaled and moved (mm) about the middle of the grid, which stays; 0 comes in."""
    y, m = poses(x[None], mask[None], [{"degrees": degrees, "scale": scale, "spacing": spacing, "shift": shift}])
    return y[0], m[0]


def _counts(masks: np.ndarray) -> np.ndarray:
    """The voxels of each mask of a stack."""
    return masks.reshape(len(masks), -1).sum(axis=1)


def geometries_accepted(before: np.ndarray, after: np.ndarray, low: float = 0.30, high: float = 3.0) -> np.ndarray:
    """geometry_accepted() of each pair of masks of two stacks."""
    was, now = _counts(before), _counts(after)
    ratio = now / np.maximum(was, 1)
    good = (was > 0) & (now > 0) & (low <= ratio) & (ratio <= high)
    touched = lambda end, axis: np.take(after, end, axis).reshape(len(after), -1).any(axis=1)
    faces = sum((touched(0, a) & touched(-1, a)).astype(int) for a in range(1, after.ndim))
    return good & (faces < 2) & (P.component_counts(after) <= np.maximum(1, P.component_counts(before)))


def geometry_accepted(before: np.ndarray, after: np.ndarray, low: float = 0.30, high: float = 3.0) -> bool:
    """Whether a moved mask may be used: neither is empty, the volume ratio is within bounds, it has no more parts than
    before (one may always be), and it touches both faces of at most one axis."""
    return bool(geometries_accepted(before[None], after[None], low, high)[0])


def without_specks(mask: np.ndarray, share: float = 0.01) -> np.ndarray:
    """Without the parts that are smaller than this share of the largest."""
    labels = P.label(mask)
    if labels.max() <= 1:
        return mask
    sizes = P.component_sizes(labels)
    return mask & np.isin(labels, np.flatnonzero(sizes >= share * sizes.max()) + 1)


#: The normal draws of a field: of each of eight modes along three axes, and of 27 bumps.
_DRAWS = 3 * 8 + 27 * 3


def _fields(rngs: list[np.random.Generator], shape) -> np.ndarray:
    """_field() for each generator, as a stack."""
    draws = np.stack([rng.normal(size=_DRAWS) for rng in rngs])
    g = P.grid(shape)
    u = np.stack([2 * p / max(1, n - 1) - 1 for p, n in zip(g, shape, strict=True)])
    edge = np.prod([1 - p**4 for p in u], axis=0)
    modes = [u[0], u[1], u[2], u[0] * u[1], u[1] * u[2], u[0] * u[2], u[0] ** 2 - 1 / 3, u[1] ** 2 + u[2] ** 2 - 2 / 3]
    out = np.zeros((len(rngs), 3, *shape))
    weight = lambda k, step, end: draws[:, k:end:step].reshape(-1, 3, 1, 1, 1)
    for k, mode in enumerate(modes):
        out += weight(k, len(modes), 24) * mode
    for b, centre in enumerate(np.ndindex(3, 3, 3)):
        r2 = sum((p - (c - 1) * 0.6) ** 2 for p, c in zip(u, centre, strict=True))
        out += weight(24 + 3 * b, 1, 27 + 3 * b) * np.exp(-r2 / (2 * 0.35**2))
    out *= edge
    longest = np.sqrt((out**2).sum(axis=1)).reshape(len(rngs), -1).max(axis=1)
    return out / np.maximum(1e-12, longest).reshape(-1, 1, 1, 1, 1)


def _field(rng: np.random.Generator, shape) -> np.ndarray:
    """A smooth displacement, its greatest length being 1: per-axis stretch, shear, bend and taper modes, and 27 bumps; 0 on the border."""
    return _fields([rng], shape)[0]


def morphs(xs: np.ndarray, masks: np.ndarray, rngs: list[np.random.Generator], strengths, least_jacobian: float = 0.05, ratio=(0.30, 3.0)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """morph() of each scan and mask of a stack; those whose field or mask isn't good yet go on."""
    fields, strength = _fields(rngs, xs.shape[1:]) * 0.25 * min(xs.shape[1:]), np.array(strengths, float)
    moves = lambda at: fields[at] * strength[at].reshape(-1, 1, 1, 1, 1)
    folds = np.arange(len(xs))
    for _ in range(15):
        folds = folds[~(P.jacobian_minima(moves(folds)) >= least_jacobian)]
        if not len(folds):
            break
        strength[folds] /= 2
    out, moved, used = xs.copy(), masks.copy(), np.zeros(len(xs))
    left, parts, before = np.setdiff1d(np.arange(len(xs)), folds), np.maximum(1, P.component_counts(masks)), np.maximum(1, _counts(masks))
    for _ in range(9):
        if not len(left):
            break
        own = moves(left)
        tried = P.warps(masks[left].astype(float), own, True) > 0.5
        n = _counts(tried)
        good = (n > 0) & (P.component_counts(tried) <= parts[left]) & (ratio[0] <= n / before[left]) & (n / before[left] <= ratio[1])
        at = left[good]
        if len(at):
            out[at], moved[at], used[at] = P.warps(xs[at], own[good]), tried[good], strength[at]
        left = left[~good]
        strength[left] /= 2
    return out, moved, used


def morph(x: np.ndarray, mask: np.ndarray, rng: np.random.Generator, strength: float, least_jacobian: float = 0.05, ratio=(0.30, 3.0)) -> tuple[np.ndarray, np.ndarray, float]:
    """Scan and mask warped alike; the field is halved until it doesn't fold (14 times at most), then until the mask
    keeps its parts and volume (8 times); else both stay. Also the strength that was used."""
    y, m, used = morphs(x[None], mask[None], [rng], [strength], least_jacobian, ratio)
    return y[0], m[0], float(used[0])


def ordered_kmeans(values: np.ndarray, k: int = 3, rounds: int = 15) -> np.ndarray:
    """The class of each value, 0 being that of the least centre: centres begin at quantiles and move to their means."""
    centres = np.quantile(values, np.arange(1, k + 1) / (k + 1))
    for _ in range(rounds):
        at = np.abs(values[:, None] - centres).argmin(axis=1)
        own = [values[at == j] for j in range(k)]
        new = np.array([v.sum() / len(v) if len(v) else c for v, c in zip(own, centres, strict=True)])
        if np.abs(new - centres).max() < 1e-12:
            break
        centres = new
    at = np.abs(values[:, None] - centres).argmin(axis=1)
    return np.argsort(np.argsort(centres, kind="stable"))[at]


def label_map(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """0 for air, 1 to 3 for the mask's tissues from dark to bright, 4 and 5 for what lies around it."""
    out = np.zeros(x.shape, int)
    if mask.any():
        out[mask] = 1 + ordered_kmeans(x[mask])
    around = P.head(x) & ~mask
    if around.any():
        out[around] = 4 + ordered_kmeans(x[around], 2)
    return out


def paint(labels: np.ndarray, rng: np.random.Generator, blur: float = 0.5) -> np.ndarray:
    """Each label in a grey of its own with its own grain, blurred and held to [0, 1]; air is dark."""
    out = np.abs(rng.normal(0, 0.01, labels.shape))
    for k in range(1, labels.max() + 1):
        at = labels == k
        out[at] = rng.uniform(0.1, 1.0) + rng.normal(0, rng.uniform(0.01, 0.05), int(at.sum()))
    return np.clip(P.gaussian(out, blur), 0, 1)


def lesion(labels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A blob within the mask's labels becomes a label of its own."""
    inside = np.argwhere((labels >= 1) & (labels <= 3))
    if not len(inside):
        return labels
    centre, r = inside[rng.integers(len(inside))], rng.uniform(0.05, 0.15) * min(labels.shape)
    near = sum((p - c) ** 2 for p, c in zip(P.grid(labels.shape), centre, strict=True)) <= r * r
    return np.where(near & (labels >= 1) & (labels <= 3), 6, labels)


def syntheses(xs: np.ndarray, masks: np.ndarray, rngs: list[np.random.Generator], strength: float = 0.3, lesion_share: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """synthesize() of each scan and mask of a stack."""
    labels = np.stack([label_map(x, m) for x, m in zip(xs, masks, strict=True)])
    fields = _fields(rngs, xs.shape[1:]) * 0.25 * min(xs.shape[1:]) * strength
    folds = np.arange(len(xs))
    while len(folds := folds[P.jacobian_minima(fields[folds]) < 0.05]):
        fields[folds] = fields[folds] / 2
    labels = P.warps(labels.astype(float), fields, True).astype(int)
    out = np.empty(xs.shape)
    for k, rng in enumerate(rngs):
        if rng.random() < lesion_share:
            labels[k] = lesion(labels[k], rng)
        out[k] = paint(labels[k], rng)
    return out, np.isin(labels, (1, 2, 3, 6))


def synthesize(x: np.ndarray, mask: np.ndarray, rng: np.random.Generator, strength: float = 0.3, lesion_share: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """A new scan from a label map of the old one, warped with its mask, and the union of the mask's labels."""
    y, m = syntheses(x[None], mask[None], [rng], strength, lesion_share)
    return y[0], m[0]


def surfaces(df: DataFrame, radius: int = 2, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Adds `inside` and `outside`, the distance (mm) of each voxel to the nearest one that isn't (is) in the mask, 0 where there is
    none, `distance` (outside less inside) and `band`, the voxels whose box of `radius` holds both kinds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for mask, shape in zip(pdf["mask"], pdf["shape"], strict=True):
            m = np.asarray(mask, bool).reshape(tuple(int(n) for n in shape))
            inner, outer = (np.where(np.isfinite(d), d, 0.0) for d in (P.distance(m, spacing), P.distance(~m, spacing)))
            found.append([inner.ravel(), outer.ravel(), P.signed_distance(m, spacing).ravel(), P.boundary_band(m, radius).ravel()])
        return pdf.assign(**{name: [f[k] for f in found] for k, name in enumerate(("inside", "outside", "distance", "band"))})

    return with_pandas(df, run, "inside array<double>, outside array<double>, distance array<double>, band array<boolean>")


def moved(df: DataFrame, kind: str, seed: int, **params) -> DataFrame:
    """Rows with `voxels` and `mask` moved together by `pose`, `morph`, `mp2rage_morphology` or `label_synthesis`; a mask that geometry_accepted()
    refuses leaves both as they are. Adds `moved`, whether they are."""

    def many(cases, xs, masks):
        rngs = [case_rng(seed, str(case), kind) for case in cases]
        if kind == "pose":
            return poses(xs, masks, [{"degrees": rng.uniform(-180, 180, 3), "scale": rng.uniform(0.9, 1.1)} | params for rng in rngs])
        if kind == "mp2rage_morphology":  # gentler, and its mask may change its volume by 15 % at most
            return morphs(xs, masks, rngs, [rng.uniform(0.08, 0.18) for rng in rngs], ratio=(0.85, 1.15))[:2]
        if kind == "morph":
            own = [{"strength": rng.uniform(0.2, 0.45)} | params for rng in rngs]
            return morphs(xs, masks, rngs, [o["strength"] for o in own], **{k: v for k, v in params.items() if k != "strength"})[:2]
        return syntheses(xs, masks, rngs, **params)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found, cases = [None] * len(pdf), list(pdf["case_id"])
        for rows, xs, masks in by_shape(pdf["voxels"], pdf["mask"], pdf["shape"]):
            ys, moved_masks = many([cases[k] for k in rows], xs, masks)
            for k, good, *now, x, m in zip(rows, geometries_accepted(masks, moved_masks), ys, moved_masks, xs, masks, strict=True):
                y, n = now if good else (x, m)
                found[k] = (y.ravel(), n.ravel(), bool(good))
        return pdf.assign(voxels=[f[0] for f in found], mask=[f[1] for f in found], moved=[f[2] for f in found])

    return with_pandas(df, run, "moved boolean")
