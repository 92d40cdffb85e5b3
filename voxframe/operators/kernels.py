"""Operators lowered to NumPy kernels: neighbourhoods, transforms, distances, warps."""

from __future__ import annotations

import numpy as np

from . import primitives as P
from .columns import master
from .registry import operator


def _clip(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0.0, 1.0)


def _top(x: np.ndarray, q: float) -> float:
    positive = x[x > 0]
    return float(np.percentile(positive, q)) if len(positive) else 0.0


def _bump(shape, centre, sigma) -> np.ndarray:
    g = P.grid(shape)
    sigma = np.broadcast_to(np.asarray(sigma, float), (len(shape),))
    return np.exp(-0.5 * sum(((p - c) / s) ** 2 for p, c, s in zip(g, centre, sigma, strict=True)))


def _pick(rng: np.random.Generator, mask: np.ndarray) -> np.ndarray:
    return np.argwhere(mask)[rng.integers(mask.sum())]


def _smooth_field(rng: np.random.Generator, shape, points: int = 3) -> np.ndarray:
    """A smooth random field of mean 0 and deviation 1."""
    field = P.resize(rng.standard_normal((points,) * len(shape)), shape)
    field -= field.mean()
    return field / max(field.std(), 1e-9)


# focal


@operator("metal", "focal", "3d", (1.0, 5.0), has_detector=True)
def metal(x, severity, rng, mask, n_metals=None, phi=None, k_arc=None):
    """Irregular star-shaped voids with a bright rim on one side and a faint halo."""
    out, size = x.copy(), np.mean(x.shape)
    for _ in range(n_metals or rng.integers(1, max(2, round(severity)) + 1)):
        c = np.array([rng.uniform(0.2, 0.8) * (n - 1) for n in x.shape])
        d = P.grid(x.shape) - c.reshape(-1, *[1] * x.ndim)
        r = np.sqrt((d**2).sum(axis=0))
        angle = np.arctan2(d[1], d[0])
        edge = size * 0.05 * severity * (1 + 0.25 * sum(np.cos(m * angle + rng.uniform(0, 2 * np.pi)) / m for m in range(2, 5)))
        side = 0.5 * (1 + np.cos(angle - (rng.uniform(0, 2 * np.pi) if phi is None else phi))) ** (k_arc or 2.0)
        rim = np.exp(-(((r - edge) / np.maximum(0.25 * edge, 0.5)) ** 2)) * side * _top(x, 99)
        out = np.maximum(np.where(r < edge, 0.0, out), rim) + 0.05 * _top(x, 99) * np.exp(-r / np.maximum(edge, 1e-3)) * (r >= edge)
    return _clip(out)


@operator("blob", "focal", "3d", (0.0, 1.0), pool=True, has_detector=True, identity_at_zero=False)
def blob(x, severity, rng, mask, radius=None):
    """Bright Gaussian cores in the mask, deep or in a band near its edge. Needs a mask."""
    if mask is None or not mask.any():
        raise ValueError("blob needs a mask")
    if severity <= 0:
        return x
    depth = P.distance(mask)
    depth[~np.isfinite(depth)] = 1
    for _ in range(1 + int(2 * severity)):
        where = depth >= 0.6 * depth.max() if rng.random() < 0.5 else mask & (depth >= min(3, depth.max())) & (depth <= 8)
        c, r = _pick(rng, where), radius or rng.uniform(0.03, 0.08) * np.mean(x.shape) + 0.5
        shape = _bump(x.shape, c, r)
        if rng.random() < 0.35:
            shape = np.maximum(shape, 0.8 * _bump(x.shape, c + rng.normal(0, r, x.ndim), 0.7 * r))
        x = x + severity * (1 - x) * shape
    return x


@operator("void", "focal", "3d", (0.0, 1.0), pool=True, has_detector=True, identity_at_zero=False)
def void(x, severity, rng, mask, radius=None):
    """A lobed loss of signal deep in the mask. Needs a mask."""
    if mask is None or not mask.any():
        raise ValueError("void needs a mask")
    if severity <= 0:
        return x
    depth = P.distance(mask)
    depth[~np.isfinite(depth)] = 1
    c, r = _pick(rng, depth >= 0.7 * depth.max()), radius or (0.05 + 0.1 * severity) * np.mean(x.shape)
    near = np.zeros(x.shape)
    for _ in range(3):
        near = np.maximum(near, _bump(x.shape, c + rng.normal(0, 0.5 * r, x.ndim), r * rng.uniform(0.6, 1.0)))
    return x * (1 - severity * (1 - np.exp(-4 * near**2)))


@operator("droppatch", "focal", "3d", (0.0, 1.0), pool=True, train=(0.2, 0.6), has_detector=True)
def droppatch(x, severity, rng, mask):
    """Three or five interior boxes lose their signal, hard or with a feathered edge."""
    for _ in range(rng.choice((3, 5))):
        side = [max(1, int(n * rng.uniform(0.08, 0.08 + 0.15 * severity))) for n in x.shape]
        low = [rng.integers(0, max(1, n - s + 1)) for n, s in zip(x.shape, side, strict=True)]
        box = np.zeros(x.shape)
        box[tuple(slice(a, a + s) for a, s in zip(low, side, strict=True))] = 1
        if rng.random() < 0.2:
            x = x * (1 - box)
        else:
            x = x * (1 - P.gaussian(box, rng.uniform(0.5, 1.0)) * (1 - rng.uniform(0, 0.3)))
    return x


@operator("metal_paint", "focal", "either", (0.0, 1.0), identity_at_zero=False)
def metal_paint(x, severity, rng, mask, orig=None, elastic_fn=None):
    """A painted blob on neighbouring slices of the last axis: dark core, bright border."""
    shape = x.shape[:2] if x.ndim == 3 else x.shape
    c, r = [rng.uniform(0.3, 0.7) * (n - 1) for n in shape], (0.05 + 0.1 * severity) * np.mean(shape)
    d = P.grid(shape) - np.reshape(c, (-1, 1, 1))
    wobble = 1 + 0.3 * np.cos(rng.integers(3, 7) * np.arctan2(d[1], d[0]) + rng.uniform(0, 2 * np.pi))
    level = np.sqrt((d**2).sum(axis=0)) / (r * wobble)
    core, border = P.gaussian((level < 1).astype(float), 0.5), P.gaussian(((level >= 1) & (level < 1.4)).astype(float), 0.5)
    painted = lambda s: _clip(s * (1 - core) + border * _top(x, 99))
    if x.ndim == 2:
        return painted(x)
    k, half = rng.integers(x.shape[2]), max(1, x.shape[2] // 16)
    for s in range(max(0, k - half), min(x.shape[2], k + half + 1)):
        x[:, :, s] = painted(x[:, :, s])
    return x


@operator("create_ring", "focal", "either", (0.0, 1.0), pool=True, identity_at_zero=False)
def create_ring(x, severity, rng, mask, orig=None, scale=None, blurr_strength=None, pos_or_neg_x=None, pos_or_neg_y=None, x_threshold=None, y_threshold=None, partial=None, div_mag=None):
    """Brightness that follows the edges of a slab of slices, on one side of each."""
    slab = [slice(None)] * x.ndim
    if x.ndim == 3:
        k, half = rng.integers(x.shape[2]), max(1, x.shape[2] // 8)
        slab[2] = slice(max(0, k - half), k + half + 1)
    part = x[tuple(slab)]
    gx, gy = P.sobel(part, 0) * (pos_or_neg_x or rng.choice((-1, 1))), P.sobel(part, 1) * (pos_or_neg_y or rng.choice((-1, 1)))
    edge = np.maximum(gx - (x_threshold or 0.0), 0) + np.maximum(gy - (y_threshold or 0.0), 0)
    if partial:
        edge = edge * (P.grid(part.shape)[0] < part.shape[0] * partial)
    edge = P.gaussian(edge, blurr_strength or 1.0)
    edge /= max(edge.max(), 1e-9) * (div_mag or 1.0)
    x[tuple(slab)] = _clip(part + (scale or 0.5 * severity) * edge)
    return x


# geometry


@operator("anisotropy", "geometry", "3d", (0.0, 1.0), pool=True, train=(0.2, 0.75), has_detector=True, identity_at_zero=False)
def anisotropy(x, severity, rng, mask, axis=None, ratio=None, slice_gap=None):
    """Thick slices: blur along an axis, decimate by the ratio, interpolate back."""
    if ratio is None:
        if severity <= 0:
            return x
        ratio = 1 + 8 * severity
    axis = int(rng.integers(x.ndim)) if axis is None else axis
    n = x.shape[axis]
    shape = list(x.shape)
    shape[axis] = max(2, round(n / ratio)) if n > 1 else 1
    sigma = np.zeros(x.ndim)
    sigma[axis] = ratio / 4
    thick = P.resize(P.gaussian(x, sigma), shape)
    if slice_gap:
        factor = np.where(np.arange(shape[axis]) % 2, 1 - slice_gap, 1.0)
        thick = thick * factor.reshape([-1 if a == axis else 1 for a in range(x.ndim)])
    return P.resize(thick, x.shape)


@operator("randomize_resolution", "geometry", "either", (0.35, 0.95), identity_at_zero=False)
def randomize_resolution(x, severity, rng, mask):
    """To a coarser grid and back, coarser still through the planes, smoothly or by nearest voxels."""
    scale = np.full(x.ndim, 0.97 - 0.65 * severity)
    scale[-1] *= rng.uniform(0.7, 1.0)
    nearest = rng.random() < 0.25
    small = P.resize(x, [max(1, round(n * s)) for n, s in zip(x.shape, scale, strict=True)], nearest)
    return _clip(P.resize(small, x.shape, nearest))


@operator("susceptibility_distortion", "geometry", "3d", (0.0, 1.0), label_preserving=False)
def susceptibility_distortion(x, severity, rng, mask, inf_axis=None, inf_low=None, geometry_only=False):
    """Two to seven low foci pull the image along one axis and take away signal."""
    axis, low = 2 if inf_axis is None else inf_axis, True if inf_low is None else inf_low
    pull, gone = np.zeros(x.shape), np.zeros(x.shape)
    for _ in range(rng.integers(2, 8)):
        c = [rng.uniform(0.2, 0.8) * (n - 1) for n in x.shape]
        c[axis] = rng.uniform(0, 0.35) * (x.shape[axis] - 1)
        c[axis] = c[axis] if low else x.shape[axis] - 1 - c[axis]
        b = _bump(x.shape, c, 0.1 * np.mean(x.shape))
        pull, gone = pull + rng.choice((-1, 1)) * b, np.maximum(gone, b)
    moves = np.zeros((x.ndim, *x.shape))
    moves[axis] = np.clip(pull, -1, 1) * min(1 + 11 * severity, 0.25 * x.shape[axis])
    while P.jacobian_minimum(moves) < 0.05:
        moves *= 0.7
    out = P.warp(x, moves)
    return out if geometry_only else out * (1 - 0.8 * severity * gone)


@operator("gradient_nonlinearity", "geometry", "3d", (0.0, 1.0), label_preserving=False)
def gradient_nonlinearity(x, severity, rng, mask, geometry_only=False):
    """A radial warp 1 + a r^2 + b r^4, with shading by the volume change."""
    half = np.reshape([(n - 1) / 2 or 1 for n in x.shape], (-1, *[1] * x.ndim))
    unit = (P.grid(x.shape) - half) / half
    r2 = (unit**2).sum(axis=0) / x.ndim
    a, b = rng.uniform(-0.12, 0.12) * severity, rng.uniform(-0.05, 0.05) * severity
    stretch = 1 + rng.uniform(-0.05, 0.05, (x.ndim, *[1] * x.ndim)) * severity
    moves = unit * half * (stretch * (1 + a * r2 + b * r2**2) - 1)
    out = P.warp(x, moves)
    return out if geometry_only else _clip(out * (1 + a * r2))


# noise


@operator("noise", "noise", "3d", (0.0, 0.4), pool=True, train=(0.1, 0.34), has_detector=True)
def noise(x, severity, rng, mask, mode=None, sigma_grain=None):
    """Thermal, Rician and structured noise mixed at random, to a total deviation in the region; not clipped."""
    goal = 0.5 * severity * rng.uniform(0.8, 1.25)
    kinds = [mode] if mode else ["thermal"] if rng.random() < 0.4 else ["thermal", "rician", "structured"]
    total = np.zeros(x.shape)
    for kind in kinds:
        if kind == "thermal":
            delta = rng.standard_normal(x.shape)
            delta = P.grain(delta, sigma_grain) if sigma_grain else delta
        elif kind == "rician":
            delta = np.hypot(x + goal * rng.standard_normal(x.shape), goal * rng.standard_normal(x.shape)) - x
        elif kind == "structured":
            delta = P.grain(rng.standard_normal(x.shape), rng.uniform(0.6, 1.5, x.ndim))
        else:
            raise ValueError(f"unknown mode {kind!r}")
        total += delta * rng.uniform(0.3, 1.0) / max(delta.std(), 1e-9)
    region = mask if mask is not None and mask.any() else np.ones(x.shape, bool)
    return x + total * (goal / max(np.sqrt((total[region] ** 2).mean()), 1e-9))


@operator("g_factor_noise", "noise", "3d", (0.0, 1.0), pool=True, train=(0.12, 0.35))
def g_factor_noise(x, severity, rng, mask):
    """Rician noise whose deviation follows a smooth map, greatest in the middle and in some lobes."""
    size = np.mean(x.shape)
    g = 1 + _bump(x.shape, [(n - 1) / 2 for n in x.shape], 0.3 * size)
    for _ in range(rng.integers(2, 7)):
        g = g + rng.uniform(0.3, 1.0) * _bump(x.shape, [rng.uniform(0, n - 1) for n in x.shape], 0.15 * size)
    sigma = (0.04 + 0.5 * severity) * _top(x, 90) * g / g.mean()
    return np.hypot(x + sigma * rng.standard_normal(x.shape), sigma * rng.standard_normal(x.shape))


@operator("mp2rage_grain", "noise", "2d", (0.0, 1.0), identity_at_zero=False)
def mp2rage_grain(x, severity, rng, mask, grain_sg=0.0, aniso=1.0):
    """A noise field smoothed, its deviation restored about its mean."""
    if grain_sg <= 0:
        return x
    sigma = np.full(x.ndim, float(grain_sg))
    sigma[0] *= aniso
    return x.mean() + P.grain(x - x.mean(), sigma, x.std())


# intensity


@operator("bias", "intensity", "3d", (0.0, 0.8), pool=True, has_detector=True)
def bias(x, severity, rng, mask, voxel_length_range=(3, 96), field_kind=None):
    """A smooth positive gain from a coarse grid, several coils or an ellipse; the region's 99th percentile is kept."""
    kind = field_kind or ("grid", "coils", "elliptical")[rng.integers(3)]
    if kind == "grid":
        log = _smooth_field(rng, x.shape, int(np.clip(np.mean(x.shape) // rng.uniform(*voxel_length_range) + 2, 2, 6)))
    elif kind == "coils":
        ring = [np.array([(n - 1) / 2 * (1 + 1.2 * s) for n, s in zip(x.shape, (np.cos(t), np.sin(t), 0.0), strict=False)]) for t in rng.uniform(0, 2 * np.pi, 4)]
        log = np.log(1e-3 + sum(rng.uniform(0.5, 1.5) * _bump(x.shape, c, 0.6 * np.mean(x.shape)) for c in ring))
    elif kind == "elliptical":
        log = _bump(x.shape, [(n - 1) * rng.uniform(0.3, 0.7) for n in x.shape], [n * rng.uniform(0.3, 0.6) for n in x.shape])
    else:
        raise ValueError(f"unknown field {kind!r}")
    log = (log - log.mean()) / max(log.std(), 1e-9)
    out = x * np.exp(severity * 0.6 * log)
    region = mask if mask is not None and mask.any() else x > 0
    if not region.any():
        return out
    return out * (np.percentile(x[region], 99) / max(np.percentile(out[region], 99), 1e-9))


@operator("chemical_shift", "intensity", "3d", (0.0, 1.0), pool=True, train=(0.12, 0.8))
def chemical_shift(x, severity, rng, mask, axis=None, shift=None):
    """The bright outer shell moves by whole voxels along an axis, without wrap: added there, taken away here."""
    axis = int(rng.integers(x.ndim)) if axis is None else axis
    fat = np.where(_shell(x, 0.2), x, 0.0) * (x > _top(x, 60))
    by = int(1 + 9 * severity * rng.random()) * int(rng.choice((-1, 1))) if shift is None else shift
    moved = P._shifted(fat, [by if a == axis else 0 for a in range(x.ndim)], 0.0)
    return _clip(x + severity * (moved - 0.8 * fat))


def _shell(x: np.ndarray, share: float) -> np.ndarray:
    inside = P.head(x)
    d = P.distance(inside)
    d[~np.isfinite(d)] = np.max(x.shape) / 2
    return inside & (d > 0) & (d <= max(1.0, share * d.max()))


@operator("incomplete_fat_sat", "intensity", "3d", (0.0, 1.0), pool=True)
def incomplete_fat_sat(x, severity, rng, mask):
    """An uneven bright residue in the thin ring outside the mask."""
    ring = _shell(x, 0.25)
    if mask is not None:
        ring &= ~mask
    uneven = np.clip(0.5 + 0.5 * _smooth_field(rng, x.shape), 0, 1)
    return _clip(x + severity * 0.6 * uneven * P.gaussian(ring.astype(float), 0.5))


def _memberships(x, low, high, width):
    """Soft memberships of dark, middle and bright tissue about two thresholds."""
    step = lambda t: 1 / (1 + np.exp(-np.clip((x - t) / max(width, 1e-6), -30, 30)))
    a, b = step(low), step(high)
    return 1 - a, a * (1 - b), a * b


def _t2(x, strength, inside, low, high, targets, width, detail_sigma, edge_k, detail_gain, skull_factor, blur_sigma):
    dark, middle, bright = _memberships(P.gaussian(x, blur_sigma), low, high, width)
    flat = targets[0] * dark + targets[1] * middle + targets[2] * bright
    detail = x - P.gaussian(x, detail_sigma)
    edges = P.gradient_magnitude(x)
    kept = detail_gain * detail / (1 + (edges / max(edge_k, 1e-6)) ** 2)
    return _clip(x + strength * (np.where(inside, flat + kept, x * skull_factor) - x))


@operator("t2_3d", "intensity", "3d", (0.0, 1.3), identity_at_zero=False)
def t2_3d(x, severity, rng, mask, master_t=None, csf_pct=20.0, gm_pct=67.0, csf_target=0.95, gm_target=0.5, wm_target=0.24, trans_frac=0.09, detail_sigma=2.0, edge_k=0.08, detail_gain=0.7, skull_factor=0.7, blur_sigma=0.6):
    """Inverted tissue contrast from soft memberships at percentiles of the mask; identity at strength 0."""
    strength = min(1.0, max(0.0, severity if master_t is None else master_t))
    if strength <= 0 or mask is None or not mask.any():
        return x
    low, high = np.percentile(x[mask], (csf_pct, gm_pct))
    width = trans_frac * max(np.ptp(x[mask]), 1e-6)
    return _t2(x, strength, mask, low, high, (csf_target, gm_target, wm_target), width, detail_sigma, edge_k, detail_gain, skull_factor, blur_sigma)


@operator("t2_remap", "intensity", "2d", (0.0, 1.0), identity_at_zero=False)
def t2_remap(x, severity, rng, mask, csf_thresh=0.2, gm_thresh=0.6, csf_target=0.9, gm_target=0.55, wm_target=0.4, mod=0.12, skull_factor=0.7, blur_sigma=0.6, trans_frac=0.09, detail_sigma=2.0, edge_k=0.08):
    """The same with fixed thresholds; the middle tissue keeps some of its own modulation. Unchanged without a mask."""
    if mask is None or not mask.any():
        return x
    out = _t2(x, 1.0, mask, csf_thresh, gm_thresh, (csf_target, gm_target, wm_target), trans_frac, detail_sigma, edge_k, 0.7, skull_factor, blur_sigma)
    return _clip(np.where(mask, out + mod * (x - x[mask].mean()), out))


def uni_air(rng: np.random.Generator, shape, centre: float = 0.5, coils: float = 32.0, inv2_scale: float = 1.0) -> np.ndarray:
    """The stored ratio image where there is only noise: Beta(N, N) for N coils of equal noise; else two Gamma norms and the
    cosine between random directions. Scaled so that its middle is `centre`, held to [0, 1]."""
    n, scale = max(float(coils), 1.0), max(float(inv2_scale), 1e-3)
    if abs(scale - 1) <= 1e-6:
        ratio = rng.beta(n, n, shape)
    else:
        a, b = rng.gamma(n, 1.0, shape), rng.gamma(n, scale**2, shape)
        around = max(n - 0.5, 0.5)
        ratio = 0.5 + np.sqrt(a * b) * (2 * rng.beta(around, around, shape) - 1) / (a + b + 1e-12)
    return np.clip(2 * centre * ratio, 0, 1)


def zero_wedge(rng: np.random.Generator, mask: np.ndarray, share: float = 0.25, tries: int = 12) -> np.ndarray:
    """The voxels beyond a tilted plane, about `share` of the volume's reach; none if each of `tries` planes would meet the mask."""
    g = P.grid(mask.shape) - (np.reshape(mask.shape, (-1, *[1] * mask.ndim)) - 1) / 2
    for _ in range(tries):
        direction = rng.standard_normal(mask.ndim)
        height = np.tensordot(direction / np.linalg.norm(direction), g, 1)
        beyond = height > height.max() - rng.uniform(0.5, 1.0) * share * np.ptp(height)
        if not (beyond & mask).any():
            return beyond
    return np.zeros(mask.shape, bool)


#: What master strength sets in the MP2RAGE look, as (clean, real, extreme).
_UNI = {"tissue": (0.0, 0.02, 0.06), "background": (0.0, 1.0, 1.0), "scalp": (0.0, 0.85, 1.0), "curve": (0.0, 1.0, 1.0)}


@operator("mp2rage_3d", "intensity", "3d", (0.0, 1.3), identity_at_zero=False)
def mp2rage_3d(x, severity, rng, mask, master_t=None, bg_mean=0.5, bg_std=0.11, tissue_noise=None, scalp_compress=0.85, boundary_width=2.0, detail_gain=0.5, detail_sigma=0.7, noise_gfactor=0.12, bg_grain_sg=0.0, tissue_noise_grain_sg=0.0, bg_fov_zero_prob=0.0, bg_fov_zero_frac=0.25, scalp_floor=0.46, scalp_gamma=0.75, lut_xs=None, lut_ys=None, brain_on=True, background_on=True, extracranial_on=True, tissue_noise_on=True, fov_padding_on=True):
    """The look of a uniform image: tissue on a fixed quantile family, noise that follows the signal,
    air as a symmetric Beta field, compressed scalp, and padding at an edge."""
    t = min(1.3, max(0.0, severity if master_t is None else master_t))
    if t <= 0 or mask is None or not mask.any():
        return x
    inside, weight = P.gaussian(mask.astype(float), 0.5 * boundary_width), {k: master(t, *v) for k, v in _UNI.items()}
    out = x.copy()
    air = ~P.dilate(P.head(x) | mask, 1)
    if extracranial_on:
        outer = ~mask & ~air
        scalp = scalp_floor + (1 - scalp_floor) * _clip(x) ** scalp_gamma * (1 - weight["scalp"] * (1 - scalp_compress))
        out = np.where(outer, x + min(t, 1.0) * (scalp * (x > 0.05) - x) * 0.7, out)
    if brain_on:
        if lut_xs is not None and lut_ys is not None:
            mapped = np.interp(x, lut_xs, lut_ys)
        else:  # rank within the mask to the family's quantiles, ties to one value
            known = np.sort(x[mask])
            rank = (np.searchsorted(known, x, "left") + np.searchsorted(known, x, "right")) / (2 * len(known))
            mapped = np.interp(rank, (0, 0.05, 0.2, 0.5, 0.8, 0.95, 1), (0.05, 0.15, 0.32, 0.55, 0.78, 0.9, 1.0))
        mapped = mapped + detail_gain * 0.2 * (x - P.gaussian(x, detail_sigma))
        out = out + weight["curve"] * inside * (mapped - out)
    if tissue_noise_on:
        draw = rng.standard_normal(x.shape)
        draw = P.grain(draw, tissue_noise_grain_sg) if tissue_noise_grain_sg > 0 else draw
        sigma = (weight["tissue"] if tissue_noise is None else tissue_noise * min(t, 1.0)) * (1 + noise_gfactor * _smooth_field(rng, x.shape))
        out = out + inside * sigma * (1.2 - _clip(out)) * draw
    if background_on and air.any():
        n = max(0.5, (bg_mean * (1 - bg_mean) / bg_std**2 - 1) * bg_mean)  # symmetric Beta of that deviation
        field = rng.beta(n, n * (1 - bg_mean) / bg_mean, x.shape)
        field = bg_mean + P.grain(field - bg_mean, bg_grain_sg, bg_std) if bg_grain_sg > 0 else field
        out = np.where(air, out + weight["background"] * (field - out), out)
        if fov_padding_on and rng.random() < bg_fov_zero_prob:
            normal = rng.standard_normal(x.ndim)
            place = np.tensordot(normal, P.grid(x.shape), 1)
            cut = place > np.quantile(place, 1 - bg_fov_zero_frac)
            if not (cut & mask).any():
                out = np.where(cut, 0.0, out)
    return _clip(out)


# k-space


def _lines(x, axis):
    """The transform along a phase axis, and its inverse."""
    return np.fft.fft(x, axis=axis), lambda k: np.fft.ifft(k, axis=axis)


def _along(values, axis, ndim):
    return np.asarray(values).reshape([-1 if a == axis else 1 for a in range(ndim)])


@operator("eye_ghosting", "kspace", "3d", (0.0, 1.0), pool=True, has_detector=True)
def eye_ghosting(x, severity, rng, mask, axis=0, anterior_low=True, bright_thr=0.3, base_amp=0.5, decay_frac=0.3, lr_axis=1, n_ghosts=4, ghost_step_frac=0.12, outside_amp=0.5, least_source=50):
    """A bright source in front of the mask leaves decaying copies along an axis; too small a source changes nothing."""
    if mask is None or not mask.any():
        return x
    place = np.argwhere(mask)
    low, high = place.min(axis=0), place.max(axis=0)
    n = x.shape[axis]
    front = np.zeros(x.shape, bool)
    box = [slice(a, b + 1) for a, b in zip(low, high, strict=True)]
    edge = low[axis] + (high[axis] - low[axis]) // 4 if anterior_low else high[axis] - (high[axis] - low[axis]) // 4
    box[axis] = slice(0, edge) if anterior_low else slice(edge, n)
    front[tuple(box)] = True
    source = front & ~mask & (x > bright_thr * _top(x, 99))
    if source.sum() < least_source:
        return x
    source = P.largest(source)
    out, bright = x.copy(), np.where(source, x, 0.0)
    for g in range(1, n_ghosts + 1):
        by = round(g * ghost_step_frac * n) * (1 if anterior_low else -1)
        copy = P.gaussian(P._shifted(bright, [by if a == axis else 0 for a in range(x.ndim)], 0.0), 0.5)
        out += severity * base_amp * np.exp(-g * ghost_step_frac / decay_frac) * copy * np.where(mask, 1.0, outside_amp)
    return _clip(out)


@operator("gibbs", "kspace", "3d", (0.0, 1.0), pool=True, has_detector=True)
def gibbs(x, severity, rng, mask, axial_axis=2):
    """Oval ringing inside the head: cosines of the depth below a moment ellipse, fading inwards, stronger at edges."""
    out, moved = x.copy(), np.moveaxis(x, axial_axis, -1)
    view = np.moveaxis(out, axial_axis, -1)
    wave, fade, turn = rng.uniform(2.5, 4.5), rng.uniform(4, 9), rng.uniform(0, 2 * np.pi)
    for k in range(moved.shape[-1]):
        s = moved[..., k]
        inside = s > P.otsu(s)
        if inside.sum() < 8:
            continue
        p = np.argwhere(inside).astype(float)
        centre, spread = p.mean(axis=0), np.cov(p.T) + 1e-6 * np.eye(2)
        d = P.grid(s.shape) - centre.reshape(2, 1, 1)
        level = np.sqrt(np.einsum("aij,ab,bij->ij", d, np.linalg.inv(spread), d)) / 2
        depth = np.maximum(0, 1 - level) * 2 * np.sqrt(np.sqrt(np.linalg.det(spread)))
        window = 0.6 + 0.4 * np.cos(2 * np.arctan2(d[1], d[0]) + turn)
        edges = P.gradient_magnitude(s)
        gain = 0.5 + 0.5 * P.gaussian(edges, 2.0) / max(edges.max(), 1e-9)
        view[..., k] += severity * 0.25 * _top(s, 95) * np.cos(2 * np.pi * depth / wave) * np.exp(-depth / fade) * window * gain * (level <= 1)
    return _clip(out)


@operator("pe_undersample", "kspace", "3d", (0.0, 1.0), pool=True, has_detector=True)
def pe_undersample(x, severity, rng, mask, magnitude=False, axis=1, centre_share=0.08):
    """Only every R-th phase-encoding line is kept, and a central band. No random draws."""
    n, every = x.shape[axis], 2 + round(3 * severity)
    freq = np.abs(np.fft.fftfreq(n) * n)
    keep = (np.arange(n) % every == 0) | (freq <= centre_share * n / 2)
    k, back = _lines(x, axis)
    out = back(k * _along(keep, axis, x.ndim))
    return _clip(np.abs(out)) if magnitude else out.real


@operator("motion_blur", "kspace", "2d", (0.0, 1.0), has_detector=True, identity_at_zero=False)
def motion_blur(x, severity, rng, mask, preset="linear_motion", sigma_a=1.5, sigma_b=0.5, length=6.0, theta=0.0):
    """Each slice filtered by a line or by an oriented Gaussian, mirrored at the edges."""
    r = max(1, int(np.ceil(length / 2 if preset == "linear_motion" else 3 * max(sigma_a, sigma_b))))
    u, w = P.grid((2 * r + 1, 2 * r + 1)) - r
    a, b = u * np.cos(theta) + w * np.sin(theta), -u * np.sin(theta) + w * np.cos(theta)
    if preset == "linear_motion":
        taps = np.clip(length / 2 + 0.5 - np.abs(a), 0, 1) * np.clip(1 - np.abs(b), 0, 1)
    elif preset == "gaussian":
        taps = np.exp(-0.5 * ((a / sigma_a) ** 2 + (b / sigma_b) ** 2))
    else:
        raise ValueError(f"unknown preset {preset!r}")
    taps /= taps.sum()
    wide = np.take(np.take(x, P._mirrored(x.shape[0], -r, x.shape[0] + r), axis=0), P._mirrored(x.shape[1], -r, x.shape[1] + r), axis=1)
    out = np.zeros(x.shape)
    for (i, j), t in np.ndenumerate(taps):
        if t:
            out += t * wide[i : i + x.shape[0], j : j + x.shape[1]]
    return out


@operator("fse_echo_train", "kspace", "3d", (0.0, 1.0), pool=True)
def fse_echo_train(x, severity, rng, mask, pe_axis=None, etl=None, decay=None, order=None, asym=None, tissue_weight=None):
    """The decay over an echo train as an envelope on the phase lines, 1 at the centre, blended by tissue brightness."""
    axis = 1 if pe_axis is None else pe_axis
    n = x.shape[axis]
    train, rate = etl or int(rng.integers(8, 25)), decay if decay is not None else severity * rng.uniform(0.05, 0.15)
    far = np.fft.fftfreq(n) * n
    if asym:
        far = np.where(far < 0, far * (1 + asym), far)
    far = np.abs(far)
    echo = np.floor(far / max(n / (2 * train), 1e-9))
    if order == "reverse":
        echo = echo.max() - echo
    envelope = np.exp(-rate * echo)
    envelope[0] = 1.0
    k, back = _lines(x, axis)
    blurred = back(k * _along(envelope, axis, x.ndim)).real
    weight = np.clip(x / max(_top(x, 99), 1e-9), 0, 1) if tissue_weight is None else tissue_weight
    return _clip(x + weight * (blurred - x))


@operator("ringing_3d", "kspace", "3d", (0.0, 1.3), pool=True, identity_at_zero=False)
def ringing_3d(x, severity, rng, mask, master_t=None, passes=None):
    """Bands along the edges of ever smaller copies of the head."""
    t = min(1.3, max(0.0, severity if master_t is None else master_t))
    if t <= 0 or not P.head(x).any():
        return x
    out, top = x.copy(), _top(x, 99)
    head = P.head(x)
    depth = P.distance(head)
    depth[~np.isfinite(depth)] = 0
    edges = P.gradient_magnitude(P.gaussian(x, 0.5))
    strong = P.gaussian((edges >= 0.2 * edges.max()).astype(float), 1.0)
    for p in range(passes or int(master(t, 4, 22, 68) * min(1.0, depth.max() / 16) + 1)):
        at = depth.max() * (p + rng.uniform(0.2, 0.8)) / (depth.max() + p + 1)
        band = np.exp(-(((depth - at) / 0.6) ** 2))
        out += band * head * (0.4 + 0.6 * strong) * rng.uniform(-1, 1) * 0.08 * t * top
    return _clip(out)


# structure


@operator("dl_recon", "structure", "3d", (0.0, 1.0), pool=True)
def dl_recon(x, severity, rng, mask):
    """Some of six effects of learned reconstruction, in random order, each blended; air stays as it is."""
    size = np.mean(x.shape)

    def smooth(y):
        return P.gaussian(y, 0.5 + severity)

    def suppress(y):
        return y - 0.8 * (y - P.gaussian(y, 1.0)) * (np.abs(y - P.gaussian(y, 1.0)) < 0.05)

    def hallucinate(y):
        return y + 0.1 * severity * P.grain(rng.standard_normal(y.shape), 1.0) * _bump(y.shape, _pick(rng, P.head(x)), 0.15 * size)

    def retexture(y):
        return P.gaussian(y, 1.0) + P.grain(rng.standard_normal(y.shape), 0.7, (y - P.gaussian(y, 1.0)).std())

    def region(y):
        w = _bump(y.shape, [rng.uniform(0, n - 1) for n in y.shape], 0.25 * size)
        return y + w * (P.gaussian(y, 1.5) - y)

    def sharpen(y):
        sharp = y + severity * (y - P.gaussian(y, 1.0))
        blocks = P.resize(P.resize(sharp, [max(1, n // 4) for n in y.shape]), y.shape, nearest=True)
        return 0.9 * sharp + 0.1 * blocks

    inside = P.head(x)
    if not inside.any():
        return x
    out, steps = x.copy(), [smooth, suppress, hallucinate, retexture, region, sharpen]
    for s in rng.permutation(len(steps)):
        if rng.random() < 0.4 + 0.5 * severity:
            out = out + severity * rng.uniform(0.4, 1.0) * (steps[s](out) - out)
    return _clip(np.where(inside, np.maximum(out, 0.02 * x.max()), x))
