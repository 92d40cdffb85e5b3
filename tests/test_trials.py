"""The benchmark's middle and the kernels that move anatomy, by their laws; files and pins by round trips."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.operators import OPERATORS, anatomy, stages
from voxframe.operators import primitives as P
from voxframe.operators.registry import apply_chosen, operator
from voxframe.plans import catalogue, routing, trials
from voxframe.sources import exports
from voxframe.sources.volumes import decode_nifti


def head(n=10):
    g = P.grid((n, n, n)) - (n - 1) / 2
    d = np.sqrt((g**2).sum(0))
    return np.clip(np.where(d < 3.6, 0.55 + 0.2 * np.sin(g[0]), np.where(d < 4.6, 0.3, 0.01)), 0, 1), d < 3.2


@pytest.fixture(scope="module")
def cases(spark):
    x, m = head()
    rows = [(f"c{k}", np.clip(x * (1 - 0.1 * k), 0, 1).ravel().tolist(), m.ravel().tolist(), [10, 10, 10], "extra") for k in range(3)]
    rows.append(("no mask", x.ravel().tolist(), [False] * 1000, [10, 10, 10], "extra"))
    return spark.createDataFrame(rows, "case_id string, voxels array<double>, mask array<boolean>, shape array<int>, status_note string")


@pytest.mark.parametrize("name", ["clean", "rotation", "resize", "resolution", "mild_mix", "FLAIR", "t2_3d", "clipping", "gibbs", "motion", "ghosting", "chemical_shift", "morphology", "label_synthesis", "realistic_appearance", "full_mix"])
def test_rendered_conditions(cases, name):
    out = {r["case_id"]: r for r in trials.render(cases, name, seed=4).collect()}
    assert len(out) == 4 and set(cases.columns) < set(next(iter(out.values())).asDict())
    source = {r["case_id"]: r for r in cases.collect()}
    for case, r in out.items():
        changed = sum(a != b for a, b in zip(r["voxels"], source[case]["voxels"], strict=True))
        assert r["changed_voxels"] == changed and len(r["voxels"]) == 1000
        if case == "no mask":
            assert r["status"] == "failed" and r["error"] and not changed
        elif name == "clean":
            assert r["status"] == "ok" and not changed
        else:
            assert r["status"] == ("ok" if changed else "unchanged") and any(r["mask"])
    again = {r["case_id"]: r["voxels"] for r in trials.render(cases.repartition(3), name, seed=4).collect()}
    assert again == {c: r["voxels"] for c, r in out.items()}


def test_unknown_conditions_and_empty_tables(cases):
    with pytest.raises(ValueError):
        trials.render(cases, "nothing")
    assert trials.render(cases.limit(0), "gibbs").count() == 0


def test_exceptions_are_retried_and_reported():
    seen = []

    def fails(times):
        def run():
            seen.append(1)
            if len(seen) <= times:
                raise RuntimeError("no luck")
            return "done"

        return run

    assert trials._attempts(fails(2), 2) == ("done", None, 3)
    seen.clear()
    assert trials._attempts(fails(9), 2) == (None, "RuntimeError: no luck", 3) and len(seen) == 3


def test_a_failing_kernel_fails_the_overlay(cases):
    @operator("always_fails", "noise", "3d", (0.0, 1.0))
    def broken(x, severity, rng, mask):
        raise ValueError("always")

    try:
        with pytest.raises(Exception, match="always"):
            apply_chosen(cases, F.lit("always_fails"), {"always_fails": 0.5}).collect()
    finally:
        del OPERATORS["always_fails"]


def test_overlay_reports_what_it_did(cases):
    rows = stages.overlay(cases.filter("case_id <> 'no mask'"), 5).collect()
    for r in rows:
        assert 1 <= len(set(r["artifacts"])) == len(r["artifacts"]) <= 2
        assert sum(a in routing.STRONG_DIMMERS for a in r["artifacts"]) <= 1
        assert all(0 <= x <= 1 for x in r["voxels"])


def test_hard_tail_keeps_what_its_gates_refuse(cases):
    source = {r["case_id"]: r["voxels"] for r in cases.collect()}
    for r in stages.hard_tail(cases.filter("case_id <> 'no mask'"), 3).collect():
        assert r["profile"] in routing.HARD_PROFILES
        assert (r["voxels"] == source[r["case_id"]]) == (r["verdict"] != "accept")


def test_shifts_beyond_the_axis():
    x = np.arange(24.0).reshape(2, 3, 4)
    for axis in range(3):
        for by in range(-9, 10):
            shift = [by if a == axis else 0 for a in range(3)]
            want = np.zeros_like(x)
            for place in np.ndindex(x.shape):
                src = list(place)
                src[axis] -= by
                if 0 <= src[axis] < x.shape[axis]:
                    want[place] = x[tuple(src)]
            assert np.array_equal(P._shifted(x, shift, 0.0), want)


def test_pose():
    x, m = head()
    same, mask = anatomy.pose(x, m)
    assert np.allclose(same, x) and np.array_equal(mask, m)
    turned, _ = anatomy.pose(x, m, degrees=(0, 0, 90))
    assert np.allclose(turned, np.rot90(x, 1, (0, 1))) or np.allclose(turned, np.rot90(x, -1, (0, 1)))
    back, _ = anatomy.pose(turned, m, degrees=(0, 0, -90))
    assert np.allclose(back, x)
    assert anatomy.pose(x, m, scale=1.5)[1].sum() > 2 * m.sum() > 6 * anatomy.pose(x, m, scale=0.6)[1].sum() / 1.6


@pytest.mark.parametrize("seed", range(4))
def test_morph_neither_folds_nor_tears(seed):
    x, m = head(12)
    y, moved, strength = anatomy.morph(x, m, np.random.default_rng(seed), 0.45)
    assert P.label(moved).max() == 1 and 0.3 <= moved.sum() / m.sum() <= 3 and y.shape == x.shape
    field = anatomy._field(np.random.default_rng(seed), x.shape) * 0.25 * 12
    assert strength == 0 or P.jacobian_minimum(field * strength) >= 0.05
    assert strength == 0 or not np.array_equal(y, x)


def test_geometry_and_specks():
    _, m = head(12)
    assert anatomy.geometry_accepted(m, m) and not anatomy.geometry_accepted(m, np.zeros_like(m)) and not anatomy.geometry_accepted(np.zeros_like(m), m)
    two = m.copy()
    two[0, 0, 0] = True
    assert not anatomy.geometry_accepted(m, two) and anatomy.geometry_accepted(two, two)
    assert np.array_equal(anatomy.without_specks(two, 0.05), m) and anatomy.without_specks(two, 0.0).sum() == m.sum() + 1
    assert not anatomy.geometry_accepted(m, np.ones_like(m))
    slab = np.zeros_like(m)
    slab[:, 5:8, 5:8] = True
    assert anatomy.geometry_accepted(slab, slab)


def test_label_synthesis():
    x, m = head(12)
    x = np.clip(x + np.random.default_rng(7).normal(0, 0.05, x.shape) * m, 0, 1)
    labels = anatomy.label_map(x, m)
    assert set(np.unique(labels[m])) == {1, 2, 3} and not np.isin(labels[~m], (1, 2, 3)).any()
    means = [x[labels == k].mean() for k in (1, 2, 3)]
    assert means == sorted(means)
    y, moved = anatomy.synthesize(x, m, np.random.default_rng(1))
    assert y.shape == x.shape and 0 <= y.min() and y.max() <= 1 and moved.any() and not np.array_equal(y, x)
    with_lesion = anatomy.lesion(labels, np.random.default_rng(2))
    assert (with_lesion == 6).any() and m[with_lesion == 6].all()


def test_kmeans_by_brute_force():
    r = np.random.default_rng(0)
    values = np.concatenate([r.normal(c, 0.02, 40) for c in (0.2, 0.5, 0.8)])
    assert np.array_equal(anatomy.ordered_kmeans(values), np.repeat([0, 1, 2], 40))
    assert set(anatomy.ordered_kmeans(np.full(5, 0.3))) <= {0, 1, 2}


def test_boundary_band_by_brute_force():
    m = np.random.default_rng(3).random((5, 4, 6)) < 0.2
    for radius in (1, 2):
        got = P.boundary_band(m, radius)
        for place in np.ndindex(m.shape):
            box = m[tuple(slice(max(0, p - radius), p + radius + 1) for p in place)]
            assert got[place] == (box.any() and not box.all())


def test_batch_gate_columns_equal_python(spark):
    rows = [(e, b, n) for e in range(4) for b in range(5) for n in (1, 8)] + [(2**31 - 1, 10**9, 3)]
    df = spark.createDataFrame(rows, "epoch int, batch int, size int")
    for seed in (0, 123456789):
        got = {tuple(r)[:3]: r["attacked"] for r in routing.with_batch_gate(df, seed, "epoch", "batch", "size", 0.4).collect()}
        assert got == {r: routing.batch_gate(seed, *r, 0.4) for r in rows}


def test_every_condition_of_the_catalogue_has_a_renderer():
    kinds = {s[2] for s in catalogue.specs()}
    assert kinds == {"clean", "spatial", "sequence", "operator", "composite"} and len(catalogue.specs()) == 70


def test_masks_manifests_and_pins(spark, tmp_path):
    mask = [True, False] * 12
    df = spark.createDataFrame([("a.nii", mask, [2, 3, 4]), ("b.nii", mask[::-1], [2, 3, 4])], "output string, mask array<boolean>, shape array<int>")
    written = exports.write_masks(df, f"{tmp_path}/masks")
    back = {r["output"]: decode_nifti(bytes(r["content"])) for r in written.collect()}
    assert np.array_equal(np.asarray(back["a.nii"]["voxels"]).ravel() > 0.5, mask) and list(back["b.nii"]["shape"]) == [2, 3, 4]
    with pytest.raises(Exception, match="(?i)exist"):
        exports.write_masks(df, f"{tmp_path}/masks")
    with pytest.raises(ValueError, match="repeat"):
        exports.write_masks(df.union(df.withColumn("output", F.upper("output"))), f"{tmp_path}/other")
    with pytest.raises(ValueError, match="input"):
        exports.write_masks(df, f"{tmp_path}/other", spark.createDataFrame([("B.NII",)], "path string"))
    (tmp_path / "m.jsonl").write_text('{"scan": "x", "mask": "y"}\n{"scan": "z", "mask": ""}\n{"scan": "w"}\n')
    assert [r["scan"] for r in exports.offline_manifest(spark, f"{tmp_path}/m.jsonl").collect()] == ["x"]
    exports.export_test_manifest(df.select("output"), "f", "f", f"{tmp_path}/test")
    with pytest.raises(ValueError):
        exports.export_test_manifest(df, "f", "g", f"{tmp_path}/test2")
    content = json.dumps({"id": "style", "x": 1}).encode()
    assert exports.pinned_asset(content, "style", hashlib.sha256(content).hexdigest())["x"] == 1
    for wrong in ((content + b" ", "style"), (content, "other")):
        with pytest.raises(ValueError):
            exports.pinned_asset(*wrong, hashlib.sha256(content).hexdigest())


def test_code_fingerprint(spark, tmp_path):
    for n, t in (("a.py", "1"), ("b/c.py", "2")):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(t)
    read = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    one = exports.code_fingerprint(read(), str(tmp_path)).first()
    names = "\n".join(sorted(f"{n}:{hashlib.sha256(t.encode()).hexdigest()}" for n, t in (("a.py", "1"), ("b/c.py", "2"))))
    assert one["files"] == 2 and one["fingerprint"] == hashlib.sha256(names.encode()).hexdigest()
    (tmp_path / "a.py").write_text("3")
    assert exports.code_fingerprint(read(), str(tmp_path)).first()["fingerprint"] != one["fingerprint"]


def test_air_and_wedge():
    from voxframe.operators.kernels import uni_air, zero_wedge

    a = uni_air(np.random.default_rng(0), 20_000, 0.5, 4.0)
    assert abs(a.mean() - 0.5) < 0.01 and abs(a.var() - 1 / (4 * 9)) < 0.002  # Beta(4, 4)
    b = uni_air(np.random.default_rng(0), 20_000, 0.5, 4.0, 1.0001)
    assert abs(b.mean() - 0.5) < 0.01 and abs(b.var() - a.var()) < 0.003  # the general law meets the special one
    _, m = head(12)
    for seed in range(5):
        w = zero_wedge(np.random.default_rng(seed), m)
        assert not (w & m).any()
    assert not zero_wedge(np.random.default_rng(0), np.ones((6, 6, 6), bool)).any()


def test_stages_with_drawn_acquisitions(cases):
    rows = stages.realistic_acquisition(cases.filter("case_id <> 'no mask'"), 1, share=1.0).collect()
    assert all(r["acquisition"]["field"] in stages.FIELDS and r["acquisition"]["sequence"] in stages.SEQUENCES for r in rows)
    assert all(0 <= x <= 1 for r in rows for x in r["voxels"])
    source = {r["case_id"]: r["voxels"] for r in cases.collect()}
    assert all(r["voxels"] == source[r["case_id"]] and r["acquisition"] is None for r in stages.realistic_acquisition(cases, 1, share=0.0).collect())


def test_samples_pair_and_are_drawn_again(spark):
    """The same seed draws the same sample up to its artifacts; anchors stay; refused geometry, null rows, other columns and redraws."""
    from voxframe.plans import samples

    g = np.random.default_rng(4)
    shape, middle, all_ = [6, 6, 6], np.zeros((6, 6, 6), bool), np.ones((6, 6, 6), bool)
    middle[2:4, 2:4, 2:4] = True
    rows = [(f"c{n}", g.random(216).tolist(), (all_ if n == 5 else middle).ravel().tolist(), shape, n) for n in range(6)] + [("c6", None, None, shape, 6), (None, [0.5] * 216, middle.ravel().tolist(), shape, 7)]
    cases = spark.createDataFrame(rows, "case_id string, voxels array<double>, mask array<boolean>, shape array<int>, route0 int")
    mix = samples.Mix(shares={"clean": 0.2, "benign": 0.8}, artifacts=1.0)
    with_, without = ({r["route0"]: r for r in samples.draw(cases, 3, m).collect()} for m in (mix, samples.without_artifacts(mix)))
    assert len(with_) == len(without) == 8 and with_[6]["kind"] is None and with_[7]["kind"] is None and with_[7]["voxels"] == [0.5] * 216
    assert with_[5]["kind"] == samples.FALLBACK and with_[5]["voxels"] == pytest.approx(rows[5][1])
    for n in range(5):
        a, b = with_[n], without[n]
        assert a["route"] == b["route"] and a["mask"] == b["mask"] and len(a["voxels"]) == 216
        assert a["kind"] == b["kind"] or a["kind"].startswith(b["kind"] + "+")
        if a["route"] == "clean":
            assert a["voxels"] == pytest.approx(rows[n][1]) and a["kind"] in ("clean", samples.FALLBACK)
    again = {r["route0"]: r for r in samples.draw_category(cases.filter("route0 >= 4 AND route0 < 6"), 3, "nonbenign", max_draws=2).collect()}
    assert not again[5]["faithful"] and again[5]["attempts"] == 2
    assert again[4]["faithful"] == ("+" in again[4]["kind"])
    with pytest.raises(ValueError):
        samples.draw_category(cases, 3, "nothing")
