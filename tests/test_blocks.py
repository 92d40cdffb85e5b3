"""Volumes that span rows: blocks, lines, components and Fourier lines, against plain versions, for several block sizes."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions import fourier
from voxframe.operators import apply_operator, blocks, components


def voxel_table(spark, **cases):
    """A row for each voxel of (values...) arrays by case."""
    rows = []
    for case, fields in cases.items():
        names = list(fields)
        for place in np.ndindex(fields[names[0]].shape):
            rows.append((case, *map(int, place), *[fields[n][place].item() for n in names]))
    kinds = {"f": "double", "b": "boolean"}
    schema = "case_id string, i int, j int, k int, " + ", ".join(f"{n} {kinds[np.asarray(v).dtype.kind]}" for n, v in next(iter(cases.values())).items())
    return spark.createDataFrame(rows, schema)


def spiral(n=9):
    """One path, a voxel wide, round and round into the middle of a plane."""
    m = np.zeros((n, n, 1), bool)
    i, j, di, dj = 0, 0, 0, 1
    m[0, 0] = True
    turns = 0
    while turns < 2:
        a, b = i + 2 * di, j + 2 * dj
        if 0 <= i + di < n and 0 <= j + dj < n and not m[i + di, j + dj] and not (0 <= a < n and 0 <= b < n and m[a, b]):
            i, j, turns = i + di, j + dj, 0
            m[i, j] = True
        else:
            di, dj, turns = dj, -di, turns + 1
    return m


def plain_components(mask, full=True):
    """The voxels of each component, by its first voxel."""
    steps = [s for s in itertools.product((-1, 0, 1), repeat=3) if any(s) and (full or sum(map(abs, s)) == 1)]
    left, found = set(map(tuple, np.argwhere(mask))), {}
    while left:
        first = min(left)
        part, todo = {first}, [first]
        while todo:
            p = todo.pop()
            for s in steps:
                q = tuple(a + b for a, b in zip(p, s, strict=True))
                if q in left and q not in part:
                    part.add(q)
                    todo.append(q)
        found[tuple(map(int, first))] = part
        left -= part
    return found


def number(place):
    i, j, k = place
    return (i * 2097152 + j) * 2097152 + k


@pytest.mark.parametrize("size", [2, 3, 16])
def test_blocks_do_not_show(spark, size):
    """Jacobian and band of odd shapes, the same for every size of block."""
    g = np.random.default_rng(3)
    fields = {c: {n: g.normal(size=shape) for n in ("di", "dj", "dk")} for c, shape in (("a", (5, 4, 3)), ("b", (2, 7, 2)))}
    fields["flat"] = {n: np.zeros((1, 3, 3)) for n in ("di", "dj", "dk")}
    fields["nan"] = {n: np.full((2, 2, 2), np.nan) for n in ("di", "dj", "dk")}
    got = {r["case_id"]: r["least"] for r in blocks.jacobian_minimum(voxel_table(spark, **fields), size).collect()}
    for c in ("a", "b"):
        j = np.array([[np.gradient(fields[c][f], axis=a) + (a == n) for a in range(3)] for n, f in enumerate(("di", "dj", "dk"))])
        assert got[c] == pytest.approx(np.linalg.det(np.moveaxis(j, (0, 1), (-2, -1))).min())
    assert got["flat"] == got["nan"] == -math.inf

    masks = {c: {"mask": g.random(shape) < 0.2} for c, shape in (("a", (5, 4, 3)), ("b", (2, 7, 2)))}
    for radius in (1, 2):
        band = {(r["case_id"], r["i"], r["j"], r["k"]): r["band"] for r in blocks.boundary_band(voxel_table(spark, **masks), radius, size).collect()}
        for c, m in masks.items():
            for p in np.ndindex(m["mask"].shape):
                box = m["mask"][tuple(slice(max(0, x - radius), x + radius + 1) for x in p)]
                assert band[(c, *p)] == (box.any() and not box.all())
    with pytest.raises(ValueError):
        blocks.with_halos(voxel_table(spark, **masks), 2, 3)


def test_lower_envelopes(spark):
    inf, g = math.inf, np.random.default_rng(1)
    lines = [[0.0, inf, inf], [inf, inf, 0.0, inf], [inf], [inf, inf], [], [3.0], [4.0, 1.0, 9.0, 0.0, inf, 2.0], *[np.where(g.random(30) < 0.3, inf, g.integers(0, 200, 30).astype(float)).tolist() for _ in range(20)]]
    for spacing in (1.0, 0.3, 7.5):
        rows = spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "n int, f array<double>").filter("size(f) > 0").select("n", blocks.lower_envelope(F.col("f"), spacing).alias("d")).collect()
        for r in rows:
            f = lines[r["n"]]
            assert r["d"] == pytest.approx([min(f[q] + (spacing * (p - q)) ** 2 for q in range(len(f))) for p in range(len(f))])


def test_signed_distance(spark):
    g = np.random.default_rng(5)
    masks = {"a": {"mask": g.random((5, 6, 4)) < 0.3}, "none": {"mask": np.zeros((2, 2, 2), bool)}, "all": {"mask": np.ones((2, 2, 2), bool)}}
    spacing = (1.0, 0.5, 3.0)
    for r in blocks.signed_distance(voxel_table(spark, **masks), spacing).collect():
        m = masks[r["case_id"]]["mask"]
        other = np.argwhere(m != r["mask"])
        own = np.sqrt((((other - [r["i"], r["j"], r["k"]]) * spacing) ** 2).sum(axis=1)).min() if len(other) else 0.0
        assert r["distance"] == pytest.approx(-own if r["mask"] else own)


def test_components_of_a_spiral_and_of_noise(spark, monkeypatch):
    monkeypatch.setattr(components, "STRETCH", 2)
    g = np.random.default_rng(8)
    turned = np.moveaxis(spiral(), 2, 0)
    masks = {"plane": spiral(), "lines": turned, "noise": g.random((6, 7, 9)) < 0.12, "none": np.zeros((2, 2, 2), bool)}
    assert spiral().sum() > 30 and len(plain_components(spiral(), False)) == 1
    table = voxel_table(spark, **{c: {"mask": m} for c, m in masks.items()})
    for full in (True, False):
        got = {(r["case_id"], r["component"]): (r["size"], r["kept"], r["noted"]) for r in components.component_sizes(table, full=full, keep_ratio=0.3).collect()}
        want = {}
        for c, m in masks.items():
            sizes = {p: len(v) for p, v in plain_components(m, full).items()}
            most = max(sizes.values(), default=0)
            want |= {(c, number(p)): (n, n >= 0.3 * most, n < 0.3 * most and n >= 0.02 * most) for p, n in sizes.items()}
        assert got == want


def test_cleaned_masks(spark):
    """A shell with a hole, a tunnel that stays open, and a speck."""
    shell = np.zeros((7, 7, 7), bool)
    shell[1:6, 1:6, 1:6] = True
    shell[2:5, 2:5, 2:5] = False
    tunnel = shell.copy()
    tunnel[3, 3, 5] = tunnel[3, 3, 6] = False
    speck = np.zeros((7, 7, 7), bool)
    speck[0:5, 0:5, 0:5] = True
    speck[6, 6, 6] = True
    table = voxel_table(spark, shell={"mask": shell}, tunnel={"mask": tunnel}, speck={"mask": speck}, none={"mask": np.zeros((2, 2, 2), bool)})
    got = {}
    for r in components.cleaned(table).collect():
        got.setdefault(r["case_id"], set()).add((r["i"], r["j"], r["k"])) if r["mask"] else got.setdefault(r["case_id"], set())
    assert len(got["shell"]) == 125 and len(got["tunnel"]) == tunnel.sum() and len(got["speck"]) == 125 and not got["none"]


def test_transforms_of_any_length(spark):
    g = np.random.default_rng(2)
    lines = [g.normal(size=n) + 1j * g.normal(size=n) for n in (1, 2, 3, 4, 5, 7, 8, 12, 16, 31, 45, 64)]
    rows = spark.createDataFrame([(n, [(float(c.real), float(c.imag)) for c in z]) for n, z in enumerate(lines)], "n int, z array<struct<re:double,im:double>>")
    for r in rows.select("n", fourier.fft(F.col("z")).alias("k"), fourier.ifft(F.col("z")).alias("x")).collect():
        for got, want in ((r["k"], np.fft.fft(lines[r["n"]])), (r["x"], np.fft.ifft(lines[r["n"]]))):
            assert np.allclose([c["re"] + 1j * c["im"] for c in got], want)


def test_motion_without_reach_changes_nothing(spark):
    """One pose that barely moves gives the volume back, whatever its shape; other columns, null voxels and repeated cases stay."""
    x = np.random.default_rng(6).random((4, 3, 5))
    rows = [("a", x.ravel().tolist(), [4, 3, 5], 1), ("a", x.ravel().tolist(), [4, 3, 5], 2), ("b", None, [4, 3, 5], 3)]
    table = spark.createDataFrame(rows, "case_id string, voxels array<double>, shape array<int>, axis int")
    for name, params in (("motion", {"n_poses": 1}), ("motion_continuous", {})):
        out = {r["axis"]: r["voxels"] for r in apply_operator(table, name, 1e-9, 3, **params).collect()}
        assert out[3] is None and np.allclose(out[1], x.ravel(), atol=1e-6) and np.allclose(out[2], x.ravel(), atol=1e-6)
        moved = {r["axis"]: r["voxels"] for r in apply_operator(table, name, 0.8, 3, **params).collect()}
        assert moved[1] == moved[2] and not np.allclose(moved[1], x.ravel(), atol=1e-3)
