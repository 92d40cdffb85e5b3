import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.operators import OPERATORS, apply_operator, chain
from voxframe.operators import primitives as P
from voxframe.operators import spatial
from voxframe.operators.registry import case_rng, operator, run_kernel


def sphere(n=12, r=4.5):
    g = P.grid((n, n, n)) - (n - 1) / 2
    d = np.sqrt((g**2).sum(0))
    return np.where(d < r, 0.8, 0.02) + 0.03 * np.sin(g[0]), d < r - 1


@pytest.fixture(scope="module")
def volumes(spark):
    rows = []
    r = np.random.default_rng(1)
    for i in range(3):
        x = r.random((4, 3, 5))
        rows.append((f"c{i}", x.ravel().tolist(), (x > 0.5).ravel().tolist(), [4, 3, 5]))
    rows.append(("zero", [0.0] * 60, [True] * 60, [4, 3, 5]))
    return spark.createDataFrame(rows, "case_id string, voxels array<double>, mask array<boolean>, shape array<int>")


def test_the_registry_is_complete():
    assert len(OPERATORS) == 66
    assert sum(o.pool for o in OPERATORS.values()) == 36
    with pytest.raises(ValueError):
        operator("noise", "noise", "3d", (0, 1))(lambda x: x)
    with pytest.raises(ValueError):
        operator("other", "noise", "4d", (0, 1))


@pytest.mark.parametrize("name", [n for n, o in OPERATORS.items() if o.lowering == "kernel"])
def test_kernels_keep_shape_and_repeat(name):
    x, m = sphere()
    op, before = OPERATORS[name], x.copy()
    severity = max(0.5, op.severity[0])
    a, b = (run_kernel(op, x, severity, case_rng(1, "a", name), m) for _ in range(2))
    assert a.shape == x.shape and np.isfinite(a).all() and np.array_equal(a, b) and np.array_equal(x, before)
    if op.identity_at_zero:
        assert np.array_equal(run_kernel(op, x, 0, case_rng(1, "a", name), m), x)


@pytest.mark.parametrize("name", [n for n, o in OPERATORS.items() if o.lowering != "kernel"])
def test_columns_keep_size(spark, volumes, name):
    op = OPERATORS[name]
    got = {r["case_id"]: r["voxels"] for r in apply_operator(volumes, name, min(0.5, op.severity[1]), 3).collect()}
    assert all(len(v) == 60 for v in got.values())
    if op.identity_at_zero:
        same = {r["case_id"]: r["voxels"] for r in apply_operator(volumes, name, 0.0, 3).collect()}
        assert same == {r["case_id"]: r["voxels"] for r in volumes.collect()}


def test_draws_depend_on_identity_only(volumes):
    one = {r["case_id"]: r["voxels"] for r in apply_operator(volumes, "rician_noise", 0.4, 3).collect()}
    two = {r["case_id"]: r["voxels"] for r in apply_operator(volumes.filter("case_id <> 'c0'").repartition(3).orderBy(F.desc("case_id")), "rician_noise", 0.4, 3).collect()}
    assert all(two[k] == one[k] for k in two)


def test_chain_and_unknown_parameters(volumes):
    out = chain(volumes, [("clipping", 0.3), ("motion", 0.5, {"n_poses": 2}), ("spin_history", 0.2)])
    assert out.count() == 4 and set(out.columns) == set(volumes.columns)
    with pytest.raises(TypeError):
        apply_operator(volumes, "clipping", 0.3, nothing=1)
    with pytest.raises(KeyError):
        apply_operator(volumes, "nothing", 0.3)


def test_primitives_against_brute_force():
    r = np.random.default_rng(2)
    m = r.random((6, 5, 4)) < 0.7
    false = np.argwhere(~m)
    brute = np.array([np.sqrt(((false - p) ** 2).sum(1)).min() for p in np.ndindex(m.shape)]).reshape(m.shape)
    assert np.allclose(P.distance(m), brute)
    labels = P.label(r.random((7, 7)) < 0.4)
    assert set(np.unique(labels)) == set(range(labels.max() + 1))
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    assert P.fill_holes(ring).all()
    taps = P.gaussian_taps(1.5)
    assert len(taps) == 13 and abs(taps.sum() - 1) < 1e-12
    assert np.allclose(P.gaussian(np.full((8, 8), 3.0), 2.0), 3.0)
    assert np.allclose(P.resize(np.arange(5.0), (9,)), np.linspace(0, 4, 9))
    assert P.jacobian_minimum(np.zeros((2, 5, 5))) == pytest.approx(1)


def test_postprocess_drops_small_parts():
    p = np.zeros((12, 12, 12))
    p[1:8, 1:8, 1:8] = 1
    p[4, 4, 4] = 0
    p[10:12, 10:12, 10:12] = 1
    mask, dropped = spatial.postprocess(p, keep_ratio=1.0)
    assert mask.sum() == 343 and dropped
    assert not spatial.postprocess(np.zeros((3, 3, 3)))[0].any()
