import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.plans import catalogue, config, evaluation, recovery, routing, splits
from voxframe.sources import listings, sinks
from voxframe.sources.volumes import decode_nifti, encode_nifti, read_nifti
from voxframe.streaming import trials


def test_undefined_scores(spark):
    rows = spark.createDataFrame([(0, 0, 0, 5), (0, 0, 3, 5), (2, 1, 1, 0)], "tp long, fp long, fn long, tn long")
    got = evaluation.scored(rows).collect()
    assert got[0]["dice"] == got[0]["iou"] == 1.0 and got[0]["precision"] is None and got[0]["recall"] is None
    assert got[1]["dice"] == 0.0 and got[1]["recall"] == 0.0 and got[2]["dice"] == pytest.approx(2 / 3)


def test_trial_seed_recipe(spark):
    row = spark.range(1).select(catalogue.trial_seed(2026, F.lit("a"), F.lit("clean"), F.lit(0)).alias("s")).first()
    assert row["s"] == "5bc2adaa2f0fe328"


def test_catalogue_has_seventy_conditions():
    specs = catalogue.specs()
    assert len(specs) == 70 and len({s[0] for s in specs}) == 70 and specs[0][0] == "clean"


def test_split_is_disjoint_and_whole(spark):
    subjects = spark.range(50).select(F.concat(F.lit("s"), "id").alias("subject"))
    rows = splits.subject_split(subjects.union(subjects), "subject", 0.2, 0.1, 1).collect()
    count = {k: sum(r["split"] == k for r in rows) for k in ("train", "val", "test")}
    assert len(rows) == 50 and count == {"train": 35, "val": 5, "test": 10}
    with pytest.raises(ValueError):
        splits.subject_split(subjects.limit(1), "subject", 0.2, 0.1, 1)


def test_fingerprint_sees_any_change(spark):
    rows = [("a", i, f"x{i}") for i in range(20)]
    of = lambda r: splits.fingerprint(spark.createDataFrame(r, "g string, i long, x string"), ["g"], ["i", "x"]).first()["fingerprint"]
    assert of(rows) == of(rows[::-1]) != of(rows[:-1]) and of(rows) != of([*rows[:-1], ("a", 19, "y")])


def test_preflight_boundary(spark):
    rows = spark.createDataFrame([("half", i < 2) for i in range(4)] + [("more", i < 1) for i in range(3)] + [("none", False)], "g string, ok boolean")
    assert {r["g"]: r["verdict"] for r in splits.preflight(rows, F.col("ok"), "g").collect()} == {"half": "go", "more": "abort", "none": "abort"}


def test_policy_rules():
    routing.Policy(mixed_fraction=0.3, target_style=0.1)
    for bad in ({"benign_fraction": 0.1, "mixed_fraction": 0.1}, {"conditional": (("a", 0.7), ("b", 0.4))}, {"mixed_fraction": 0.5, "target_style": 0.1}, {"hard_tail": 0.2}):
        with pytest.raises(ValueError):
            routing.Policy(**bad)
    assert 0.2 < sum(routing.batch_gate(1, e, b, 8, 0.25) for e in range(40) for b in range(50)) / 2000 < 0.3


def test_recovery_checks(spark):
    plan = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "case string, repeat int")
    rows = spark.createDataFrame([("a", 0), ("a", 0), ("c", 0), ("b", 0)], "case string, repeat int")
    got = {(r["case"], r["repeat"]): r["problem"] for r in recovery.problems(plan, rows, ["case", "repeat"]).collect()}
    assert got == {("a", 0): "duplicate", ("a", 1): "missing", ("c", 0): "outside"}
    steps = spark.createDataFrame([("r", 1, 4, 2), ("r", 2, 2, 1), ("s", 1, 4, 2), ("s", 2, 4, 2)], "run string, k int, b int, a int")
    assert {r["run"]: r["valid"] for r in recovery.backoff_valid(steps, ["run"], ["k"], "b", "a").collect()} == {"r": True, "s": False}
    history = spark.createDataFrame([("x", 0, 0.5), ("x", 1, 0.9), ("x", 2, 0.9), ("y", 0, 0.1), ("y", 2, 0.2)], "run string, epoch int, score double")
    assert {r["run"]: r["contiguous"] for r in recovery.contiguous(history, ["run"], "epoch").collect()} == {"x": True, "y": False}
    assert {r["run"]: r["best_index"] for r in recovery.best(history, ["run"], "score", "epoch").collect()} == {"x": 1, "y": 2}


def test_config_is_complete_and_strict():
    got = config.resolve({}, [{"name": "motion", "parameters": {"n_poses": 4}}])
    assert len(got["augmentations"]) == 86
    for bad in ({"schema_version": 2}, {"extra": 1}):
        with pytest.raises(ValueError):
            config.resolve(bad)
    for o in ({"name": "nothing"}, {"name": "motion", "parameters": {"nothing": 1}}, {"name": "motion", "severity_range": [1, 0]}, {"name": "donor_histogram_transfer", "enabled": True}):
        with pytest.raises(ValueError):
            config.resolve({}, [o])
    assert config.deep_merge({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}


def test_nifti_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).random((3, 4, 5)).astype("f4")
    affine = np.diag([1.0, 2.0, 3.0, 1.0])
    got = decode_nifti(encode_nifti(x, affine))
    assert got["shape"] == [3, 4, 5] and np.allclose(got["voxels"], x.ravel()) and np.allclose(got["spacing_mm"], [1, 2, 3])
    (tmp_path / "a.nii").write_bytes(encode_nifti(x, affine))
    (tmp_path / "bad.nii").write_bytes(b"nothing")
    rows = {r["case_id"].rsplit("/", 1)[1]: r for r in read_nifti(spark, f"file://{tmp_path}").collect()}
    assert rows["a.nii"]["error"] is None and len(rows["a.nii"]["voxels"]) == 60 and rows["bad.nii"]["error"]
    # A header needs only the file's beginning: one whose voxels are cut off, or gzipped and broken later, is read.
    (tmp_path / "cut.nii").write_bytes(encode_nifti(x, affine)[:360])
    (tmp_path / "z.nii.gz").write_bytes(gzip.compress(encode_nifti(np.random.default_rng(0).random((20, 20, 20)), affine))[:5000])
    heads = {r["case_id"].rsplit("/", 1)[1]: r for r in read_nifti(spark, f"file://{tmp_path}", header_only=True).collect()}
    assert list(heads["a.nii"]["shape"]) == list(heads["cut.nii"]["shape"]) == [3, 4, 5] and heads["a.nii"]["voxels"] is None and heads["bad.nii"]["error"]
    assert list(heads["z.nii.gz"]["shape"]) == [20, 20, 20] and np.allclose(heads["z.nii.gz"]["spacing_mm"], [1, 2, 3])


def test_manifest_rules(spark, tmp_path):
    def read(rows):
        p = tmp_path / "m.json"
        p.write_text(json.dumps({"cases": rows}))
        return listings.read_manifest(spark, f"file://{p}").collect()

    assert [r["id"] for r in read([{"scan": "a", "mask": "b"}, {"scan": "c", "mask": "d", "id": "z"}])] == ["1", "z"]
    for bad in ([], [{"scan": "a"}], [{"scan": "a", "mask": "a"}], [{"scan": "a", "mask": "b"}, {"scan": "a", "mask": "c"}]):
        with pytest.raises(ValueError):
            read(bad)
    for name, text in (("l.jsonl", '{"scan": "a", "mask": "b", "id": 7}\n{"scan": "/c", "mask": "s3://d/e"}\n'), ("l.csv", "id,scan,mask\n7,a,b\n,/c,s3://d/e\n"), ("l.json", '[{"scan": "a", "mask": "b", "id": 7}, {"scan": "/c", "mask": "s3://d/e"}]')):
        (tmp_path / name).write_text(text)
        rows = sorted(tuple(r) for r in listings.read_manifest(spark, f"file://{tmp_path}/{name}").collect())
        assert rows == [("2", "/c", "s3://d/e"), ("7", f"file://{tmp_path}/a", f"file://{tmp_path}/b")]


def test_pairs_and_sinks(spark, tmp_path):
    scans = spark.createDataFrame([("a", "a.nii"), ("b", "b.nii"), ("c", "c.nii")], "key string, path string")
    masks = spark.createDataFrame([("a_m", "1"), ("b_m", "2"), ("b_m", "3")], "key string, path string")
    pairs = listings.pair_masks(scans, masks, "_m")
    assert {r["key"]: r["discovery_error"] for r in pairs.collect()} == {"a": None, "b": "ambiguous", "c": "missing"}
    with pytest.raises(ValueError):
        listings.require_pairs(pairs)
    sinks.write_report(spark.createDataFrame([(1, float("nan"))], "i int, x double"), scans, f"file://{tmp_path}/r")
    assert spark.read.json(f"file://{tmp_path}/r/results").first()["i"] == 1
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_report(scans, scans, f"file://{tmp_path}/r")


def test_streaming_counts_and_journal(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,id*10) AS ts, id % 3 AS user_id, 'a' AS event_type, cast(id AS double) AS value, '' AS props FROM range(30)")
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = trials.trial_stream(spark, f"file://{tmp_path}/in")
    q = trials.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    batch = {tuple(r) for r in trials.windowed_counts(rows).collect()}
    assert {tuple(r) for r in spark.table("counts").collect()} == batch
    trials.journal(trials.once_per_trial(stream), f"file://{tmp_path}/j", f"file://{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/j").count() == 30
