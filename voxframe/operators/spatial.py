"""Index remaps, patches and mask post-processing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import primitives as P
from .registry import ColumnVolume, with_pandas


def flipped(v: ColumnVolume, axis: int) -> Column:
    def one(_: Column, *place: Column) -> Column:
        p = list(place)
        p[axis] = v.size(axis) - 1 - p[axis]
        return v.at(*p)

    return v.map(one)


def flip_mean(v: ColumnVolume) -> Column:
    """The mean of a volume and its three mirror images, as flip test-time averaging of a model that commutes with them gives."""

    def one(x: Column, *place: Column) -> Column:
        out = x
        for a in range(3):
            p = list(place)
            p[a] = v.size(a) - 1 - p[a]
            out = out + v.at(*p)
        return out / 4.0

    return v.map(one)


def reorient(v: ColumnVolume, order: tuple[int, int, int], flips: tuple[bool, bool, bool]) -> tuple[Column, Column]:
    """Axes permuted (new axis a is old axis order[a]), then flipped: new voxels and shape. Lossless."""
    shape = [v.size(a) for a in order]

    def one(idx: Column) -> Column:
        place = [F.floor(idx / (shape[1] * shape[2])).cast("int"), F.floor(idx / shape[2]).cast("int") % shape[1], idx % shape[2]]
        old: list = [None] * 3
        for a, (axis, flip) in enumerate(zip(order, flips, strict=True)):
            old[axis] = shape[a] - 1 - place[a] if flip else place[a]
        return v.at(*old)

    return F.transform(F.sequence(F.lit(0), F.size(v.voxels) - 1), one), F.array(*shape)


def inverse_orientation(order: tuple[int, int, int], flips: tuple[bool, bool, bool]) -> tuple[tuple[int, ...], tuple[bool, ...]]:
    back = tuple(order.index(a) for a in range(3))
    return back, tuple(flips[order.index(a)] for a in range(3))


def sliding_blend(v: ColumnVolume, patch: int, stride: int, predict) -> Column:
    """predict(value, patch number) of each voxel in all patches that hold it, averaged with Gaussian
    weights (sigma an eighth of the patch) about each patch's centre."""
    sigma = patch * 0.125

    def one(x: Column, *place: Column) -> Column:
        total = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
        starts = [F.sequence(F.lit(0), F.greatest(F.lit(0), v.size(a) - patch), F.lit(stride)) for a in range(3)]
        triples = F.flatten(F.flatten(F.transform(starts[0], lambda i: F.transform(starts[1], lambda j: F.transform(starts[2], lambda k: F.array(i, j, k))))))

        def add(acc: Column, t: Column) -> Column:
            inside, r2, number = F.lit(True), F.lit(0.0), F.lit(0)
            for a in range(3):
                s = F.get(t, a)
                inside &= (place[a] >= s) & (place[a] < s + patch)
                d = place[a] - s - (patch - 1) / 2.0
                r2, number = r2 + d * d, number * 1000 + s
            w = F.when(inside, F.exp(-r2 / (2.0 * sigma * sigma))).otherwise(0.0)
            return F.struct((acc["s"] + w * predict(x, number)).alias("s"), (acc["w"] + w).alias("w"))

        return F.aggregate(triples, total, add, lambda t: F.when(t["w"] > 0, t["s"] / t["w"]))

    return v.map(one)


def postprocess(probability: np.ndarray, threshold: float = 0.6, keep_ratio: float = 1.0, dilation: float = 0, spacing=None) -> tuple[np.ndarray, bool]:
    """Threshold, components of at least keep_ratio of the largest, holes filled, dilated by voxels (or mm with a spacing);
    and whether a component of 2 % of the largest or more was dropped."""
    mask, dropped = probability >= threshold, False
    if mask.any():
        labels = P.label(mask)
        sizes = P.component_sizes(labels)
        keep = sizes >= keep_ratio * sizes.max()
        dropped = bool((~keep & (sizes >= 0.02 * sizes.max())).any())
        mask = P.fill_holes(np.r_[False, keep][labels])
        if dilation:
            mask = P.distance(~mask, spacing) <= dilation if spacing is not None else P.dilate(mask, int(dilation))
    return mask, dropped


def postprocess_masks(df: DataFrame, voxels: str = "voxels", threshold: float = 0.6, keep_ratio: float = 1.0, dilation: float = 0) -> DataFrame:
    """Adds `mask`, `mask_fraction` and `dropped_component`; volumes go one by one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [postprocess(np.asarray(a, float).reshape([int(n) for n in s]), threshold, keep_ratio, dilation) for a, s in zip(pdf[voxels], pdf["shape"], strict=True)]
        return pdf.assign(mask=[m.ravel() for m, _ in got], mask_fraction=[float(m.mean()) for m, _ in got], dropped_component=[d for _, d in got])

    return with_pandas(df.drop("mask"), run, "mask array<boolean>, mask_fraction double, dropped_component boolean")


def components(df: DataFrame, mask: str = "mask") -> DataFrame:
    """Adds `component_sizes`, greatest first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(component_sizes=[np.sort(P.component_sizes(P.label(np.asarray(a, bool).reshape([int(n) for n in s]))))[::-1].astype("i8") for a, s in zip(pdf[mask], pdf["shape"], strict=True)])

    return with_pandas(df, run, "component_sizes array<long>")
