"""Conformed grids against a whole-volume map by inverse matrices, and splines against a dense system."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.operators import conform


def spline(x):
    """Coefficients by a dense system over the mirrored line."""
    n = len(x)
    if n == 1:
        return x
    m = np.zeros((n, n))
    for k in range(n):
        for d, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
            p = (k + d) % (2 * n - 2)
            m[k, min(p, 2 * n - 2 - p)] += w
    return np.linalg.solve(m, x)


def at(c, p):
    n = len(c)
    if p < 0 or p > n - 1:
        return 0.0
    if n == 1:
        return c[0]
    out = 0.0
    for i in range(math.floor(p) - 1, math.floor(p) + 3):
        t, q = abs(p - i), i % (2 * n - 2)
        out += ((4 - 6 * t * t + 3 * t**3) / 6 if t < 1 else max(0.0, 2 - t) ** 3 / 6) * c[min(q, 2 * n - 2 - q)]
    return out


def test_splines(spark):
    g = np.random.default_rng(1)
    lines = [g.normal(size=n).tolist() for n in (1, 2, 3, 5, 12, 40)]
    places = [-0.5, 0.0, 0.3, 1.0, 1.7, 3.99, 10.5, 11.0, 11.01, 38.6]
    rows = spark.createDataFrame([(n, x, places) for n, x in enumerate(lines)], "n int, x array<double>, p array<double>")
    for r in rows.select("n", conform.coefficients(F.col("x")).alias("c"), conform.cubic(F.col("x"), F.col("p")).alias("y"), conform.nearest(F.col("x"), F.col("p")).alias("near")).collect():
        x = np.array(lines[r["n"]])
        assert np.allclose(r["c"], spline(x)) and np.allclose(r["y"], [at(spline(x), p) for p in places])
        assert r["near"] == [x[math.floor(p + 0.5)] if 0 <= p <= len(x) - 1 else None for p in places]
    # A cubic comes back exactly where the ends' mirror isn't felt.
    cubic = [0.01 * (k - 20) ** 3 - 0.2 * (k - 20) ** 2 + k for k in range(60)]
    got = spark.createDataFrame([(cubic, [29.25, 30.5, 31.875])], "x array<double>, p array<double>").select(conform.cubic(F.col("x"), F.col("p")).alias("y")).first()["y"]
    assert got == pytest.approx([0.01 * (k - 20) ** 3 - 0.2 * (k - 20) ** 2 + k for k in (29.25, 30.5, 31.875)], abs=1e-6)


def test_target_grids(spark):
    """All 48 ways to turn and reverse the axes: the target's voxels, taken back by the inverse affine, are what conform() samples."""
    g = np.random.default_rng(2)
    shape, out, mm, rows, want = (4, 5, 3), (3, 4, 6), 1.1, [], {}
    for n, (order, signs) in enumerate(itertools.product(itertools.permutations(range(3)), itertools.product((1, -1), repeat=3))):
        spacing = g.uniform(0.6, 2.0, 3)
        a = np.eye(4)
        for source, world in enumerate(order):
            a[:3, source] = 0
            a[world, source] = signs[source] * spacing[source]
        turn = 0.05 * g.normal(size=3)  # a little oblique
        cx, cy, cz = np.cos(turn)
        sx, sy, sz = np.sin(turn)
        rotate = np.array([[cy * cz, -cy * sz, sy], [sx * sy * cz + cx * sz, cx * cz - sx * sy * sz, -sx * cy], [sx * sz - cx * sy * cz, cx * sy * sz + sx * cz, cx * cy]])
        a[:3, :3] = rotate @ a[:3, :3]
        a[:3, 3] = g.normal(size=3)
        want[n] = (a, order, signs, spacing)
        rows.append((n, a.ravel().tolist(), list(shape)))
    table = spark.createDataFrame(rows, "case_id int, affine array<double>, shape array<int>")
    targets = {r["case_id"]: np.array(r["t"]).reshape(4, 4) for r in table.select("case_id", conform.target_affine(F.col("affine"), F.col("shape"), out, mm).alias("t")).collect()}
    ramp = np.arange(60, dtype=float).reshape(shape)
    few = [5, 17, 40]
    voxels = spark.createDataFrame([(n, *map(int, p), float(ramp[p]), bool(ramp[p] % 7 < 3)) for n in few for p in np.ndindex(shape)], "case_id int, i int, j int, k int, value double, mask boolean")
    got = {(r["case_id"], r["i"], r["j"], r["k"]): r for r in conform.conform(voxels, table, out, mm).collect()}
    assert len(got) == len(few) * 72
    for n, (a, order, signs, spacing) in want.items():
        t = targets[n]
        assert np.allclose(np.linalg.norm(t[:3, :3], axis=0), mm) and all(t[w, w] > 0.9 * mm for w in range(3))
        back = np.linalg.inv(a) @ t
        if n in few:
            c = np.apply_along_axis(spline, 2, np.apply_along_axis(spline, 1, np.apply_along_axis(spline, 0, ramp)))
            for o in np.ndindex(out):
                p = (back @ [*o, 1])[:3]
                if any(abs(x) < 1e-9 or abs(x - m + 1) < 1e-9 for x, m in zip(p, shape, strict=True)):
                    continue  # on the rim rounding decides
                value = c
                for x in p:
                    value = np.apply_along_axis(at, 0, value, x)
                assert got[(n, *o)]["value"] == pytest.approx(float(value), abs=1e-6)
                inside = all(0 <= x <= m - 1 for x, m in zip(p, shape, strict=True))
                if not any(abs(x % 1 - 0.5) < 1e-9 for x in p):
                    assert got[(n, *o)]["mask"] == (inside and bool(ramp[tuple(math.floor(x + 0.5) for x in p)] % 7 < 3))
