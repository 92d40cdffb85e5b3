"""Steps whose cost must not outgrow their input."""

import datetime
import hashlib

import numpy as np
import pyarrow as pa
import test_runs
from pyspark.sql import functions as F

from voxframe.functions import fourier, tasks
from voxframe.operators import OPERATORS, anatomy, blocks, components, registry
from voxframe.operators import primitives as P
from voxframe.plans import recovery, samples, specifications, trials
from voxframe.plans.routing import STRONG_DIMMERS
from voxframe.streaming import runs


def test_line_spectra_of_lines_of_all_lengths_with_nulls(spark):
    rng = np.random.default_rng(1)
    lines = {k: rng.normal(size=n).tolist() for k, n in enumerate((1, 2, 7, 63, 64, 0, 63, 5))} | {8: None}
    lines[7][2] = None
    df = spark.createDataFrame([(k, v) for k, v in lines.items()], "id long, v array<double>").coalesce(1)
    got = {r.id: r for r in fourier.line_spectra(df, "v", lines=3).collect()}
    assert len(got) == len(lines) and got[8].re is None and got[8].im is None
    assert got[7].re == got[7].im == [None] * 5 and got[5].re == []
    for k in (0, 1, 2, 3, 4, 6):
        assert got[k].v == lines[k]
        np.testing.assert_allclose(np.array(got[k].re) + 1j * np.array(got[k].im), np.fft.fft(lines[k]), atol=1e-12)


def _uniform(*parts) -> float:
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def test_full_mix_ranks_the_pool_for_the_draw_it_takes_alone(spark):
    pool = [n for n, o in OPERATORS.items() if o.pool]
    choice = trials.full_mix_choice(3, F.col("id").cast("string"))
    # One ranking of the pool, and a coin for each of six draws.
    assert str(choice._jc.toString()).count("sha2(") == 7
    for r in spark.range(300).select("id", choice.alias("m")).collect():
        k = next((k for k in range(6) if _uniform(3, r.id, "mix", k, "count") >= 0.5), None)
        if k is None:
            assert r.m.artifacts is None and r.m.attempts == r.m.rejected == 6
            continue
        first, *others = sorted(pool, key=lambda n: (_uniform(3, r.id, "mix", k, n), n))
        second = next(n for n in others if not (first in STRONG_DIMMERS and n in STRONG_DIMMERS))
        assert r.m.artifacts == [first, second] and r.m.attempts == k + 1 and r.m.rejected == k


def test_values_of_specifications_are_read_once(spark):
    rows = spark.range(1).select(F.concat(F.lit('{"seed": '), F.col("id").cast("string"), F.lit("}")).alias("spec"))
    plan = specifications.migrated(rows).select("error", "fields")._jdf.queryExecution().optimizedPlan().toString()
    # The record itself and each triple, as far as the plan shows its columns.
    assert 1 <= plan.count("from_json(") <= 1 + len(specifications.TRIPLES)


def _volumes(spark, n: int):
    place = [(F.col("id") % 512 / 64).cast("int").alias("i"), (F.col("id") % 64 / 8).cast("int").alias("j"), (F.col("id") % 8).cast("int").alias("k")]
    return spark.range(512 * n).select(F.floor(F.col("id") / 512).alias("case_id"), *place, F.rand(1).alias("value"))


def test_no_table_of_components_passes_through_the_driver(spark):
    masks = _volumes(spark, 2).withColumn("mask", F.col("value") > 0.6)
    found = components.component_runs(masks)
    for df in (components.links(components.runs(masks)), components._large_star(found.select("case_id", F.col("component").alias("u"), F.col("run").alias("v"))), found, components.component_sizes(masks), components.cleaned(masks)):
        df.count()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_jacobian_is_numpys_and_odd_volumes_are_never_accepted(spark):
    fields = {c: F.col("value") * s for c, s in (("di", 0.5), ("dj", -0.3), ("dk", 0.2))}
    rows = _volumes(spark, 4).withColumns(fields).drop("value").toPandas()
    rows.loc[(rows.case_id == 1) & (rows.i == 7) & (rows.j == 7) & (rows.k == 7), "dj"] = None
    rows = rows[(rows.case_id != 2) | (rows.k == 3)]  # an axis of one voxel
    rows = rows[(rows.case_id != 3) | (rows.i + rows.j + rows.k != 9)]  # holes
    df = spark.createDataFrame(rows)
    for size in (2, 3, 8):
        made = blocks.jacobian_minimum(df, size)
        assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
        got = dict(made.collect())
        x = [rows[rows.case_id == 0].sort_values(["i", "j", "k"])[c].to_numpy().reshape(8, 8, 8) for c in ("di", "dj", "dk")]
        m = np.array([np.gradient(f) for f in x]).reshape(3, 3, -1).transpose(2, 0, 1) + np.eye(3)
        assert abs(got[0] - np.linalg.det(m).min()) < 1e-9
        assert got[1] == got[2] == got[3] == float("-inf")
    assert blocks.jacobian_minimum(df.limit(0)).count() == 0


def test_pandas_gets_small_parts_of_a_batch(spark):
    df = spark.range(5000).select("id", F.array_repeat(F.col("id").cast("double"), 3).alias("voxels")).coalesce(1)

    def sized(pdf):
        return pdf.assign(voxels=[v + 1 for v in pdf["voxels"]], rows=len(pdf))

    got = registry.with_pandas(df, sized, "rows int", changed=("voxels",)).collect()
    assert [r.id for r in got] == list(range(5000)) and max(r.rows for r in got) == registry.PART[0]
    assert all(r.voxels == [r.id + 1.0] * 3 for r in got)
    wide = pa.RecordBatch.from_arrays([pa.array([list(range(1 << 17))] * 9)], names=["x"])
    assert [p.num_rows for p in registry.parts(wide)] == [3, 3, 3]


def test_runs_that_share_a_bucket_keep_their_own_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "BUCKETS", 2)
    test_runs.test_stopped_and_resumed_stream_equals_the_batch(spark, tmp_path)
    # A run that idles while others of its bucket go on.
    schema = "run string, event_id long, ts timestamp, oom boolean"
    start = datetime.datetime(2024, 1, 1)
    for n, found in enumerate(([("a", 0), ("b", 0)], [("b", 200)], [("b", 400)], [("a", 410), ("b", 410)])):
        spark.createDataFrame([(run, n, start + datetime.timedelta(seconds=t), run == "a") for run, t in found], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        states = runs.run_states(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 16, 60, 250)
        runs.start(states, f"{tmp_path}/made", f"{tmp_path}/marks").awaitTermination()
    got = spark.read.schema(runs.RESULT).parquet(f"{tmp_path}/made")
    idle = [(r.run, r.ts, r.batch_size, r.report) for r in got.filter("event_id IS NULL").collect()]
    assert ("a", start, 8, True) in idle
    assert {(r.run, r.event_id): r.batch_size for r in got.filter("event_id IS NOT NULL").collect()} == {("a", 0): 16, ("b", 0): 16, ("b", 1): 16, ("b", 2): 16, ("a", 3): 16, ("b", 3): 16}


def test_problems_are_counted_in_as_many_parts_as_rows_ask_for(spark, monkeypatch):
    assert tasks.parts_for(spark.range(100)) == 4
    monkeypatch.setattr(tasks, "ROWS", 10)
    plan, rows = spark.range(100).withColumnRenamed("id", "key"), spark.createDataFrame([(k,) for k in [*range(1, 100), 5, 200, 200]], "key long")
    parts = tasks.parts_for(plan)
    assert parts == 10
    made = recovery.problems(plan, rows, ["key"], parts)
    found = made.withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r.key, r.problem) for r in found) == [(0, "missing"), (5, "duplicate"), (200, "outside")] == sorted(map(tuple, recovery.problems(plan, rows, ["key"]).collect()))
    assert "hashpartitioning(key#" in (text := made._jdf.queryExecution().executedPlan().toString()) and text.count("HashAggregate") + text.count("SortAggregate") >= 1
    assert made.rdd.getNumPartitions() == parts


def _flooded(mask) -> int:
    """The components of a mask, by plain flooding."""
    left, found = set(map(tuple, np.argwhere(mask))), 0
    while left:
        found, todo = found + 1, [left.pop()]
        while todo:
            at = todo.pop()
            near = {n for n in left if max(abs(a - b) for a, b in zip(at, n, strict=True)) <= 1}
            left -= near
            todo += near
    return found


def test_anatomy_takes_stacks_in_as_many_steps_as_one_volume(monkeypatch):
    rng, calls = np.random.default_rng(3), []
    xs, masks = rng.random((60, 5, 4, 6)), rng.random((60, 5, 4, 6)) < rng.random((60, 1, 1, 1))
    masks[0], masks[1] = False, True
    assert P.component_counts(masks).tolist() == [P.label(m).max() for m in masks] == [_flooded(m) for m in masks]
    cases, own = [str(k) for k in range(60)], P.jacobian_minima
    monkeypatch.setattr(P, "jacobian_minima", lambda d: calls.append(len(d)) or own(d))
    for name in ("morphology", "label_synthesis", "mild_mix"):
        many, calls[:] = trials._composite(name, 7, 0) if name != "mild_mix" else trials._mild(name, 7, 0), []
        made = many(cases, xs, masks)
        # A field that folds is halved 14 times at most, in one step for all that still do.
        assert len(calls) <= 15 and (not calls or calls[0] == 60)
        for k, (y, m) in enumerate(made):
            (alone, mask), = many(cases[k : k + 1], xs[k : k + 1], masks[k : k + 1])
            np.testing.assert_array_equal(y, alone)
            np.testing.assert_array_equal(m, mask)
    moved = np.stack([m for _, m in trials._composite("label_synthesis", 7, 0)(cases, xs, masks)])
    assert anatomy.geometries_accepted(masks, moved).tolist() == [anatomy.geometry_accepted(a, b) for a, b in zip(masks, moved, strict=True)]


def test_a_rows_error_is_its_own_in_a_stack(spark):
    def many(cases, xs, masks):
        if "2" in cases:
            raise ValueError("odd")
        return list(zip(xs + 1, masks, strict=True))

    rows = spark.range(4).select(F.col("id").alias("case_id"), F.array_repeat(F.lit(0.0), 8).alias("voxels"), F.array_repeat(F.lit(True), 8).alias("mask"), F.when(F.col("id") < 3, F.array(F.lit(2), F.lit(2), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("shape"))
    got = trials._rendered(rows.coalesce(1), many, 1).collect()
    assert [(r.case_id, r.voxels[0], r.error, r.attempts) for r in got] == [(0, 1.0, None, 1), (1, 1.0, None, 1), (2, 0.0, "ValueError: odd", 2), (3, 1.0, None, 1)]


def test_what_made_the_cases_of_a_plan_runs_once(spark):
    cases = spark.range(3).select(F.col("id").alias("case_id"), F.array_repeat(F.rand(1), 8).alias("voxels"), F.array_repeat(F.lit(True), 8).alias("mask"), F.array(F.lit(2), F.lit(2), F.lit(2)).alias("shape"))
    made = trials.render_plan(cases, ["clean", "clipping"], 1, 4)
    assert "Range (" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == 6


def test_the_guard_judges_volumes_of_several_shapes(spark, monkeypatch):
    """In one task, in stacks by shape, with the verdicts of geometry_accepted() on each pair."""
    rng, rows = np.random.default_rng(5), []
    for k in range(40):
        shape = [(4, 4, 4), (3, 5, 4)][k % 2]
        before, after = (rng.random(shape) < p for p in rng.random(2))
        after[0], after[:, -1] = False, False  # it touches both faces of one axis at most
        rows.append((k, list(shape), [0.0] * before.size, [1.0] * before.size, before.ravel().tolist(), after.ravel().tolist(), "made", bool(anatomy.geometry_accepted(before, after))))
    df = spark.createDataFrame(rows, "case_id int, shape array<int>, _image array<double>, voxels array<double>, _target array<boolean>, mask array<boolean>, kind string, good boolean").coalesce(1)
    got = {r.case_id: r for r in samples._guarded(df).collect()}
    assert len(got) == 40 and {r.good for r in got.values()} == {True, False}
    for k, shape, source, made, before, after, _, good in rows:
        r = got[k]
        assert (r.kind, r.voxels, r.mask, r.shape) == (("made", made, after, shape) if good else (samples.FALLBACK, source, before, shape))
    judges, calls, own = [], [], anatomy.geometries_accepted
    monkeypatch.setattr(samples, "with_pandas", lambda df, judge, *_, **__: judges.append(judge) or df.withColumn("accepted", F.lit(True)))
    samples._guarded(df)
    monkeypatch.setattr(anatomy, "geometries_accepted", lambda a, b: calls.append(len(a)) or own(a, b))
    assert judges[0](df.toPandas())["accepted"].tolist() == [r[-1] for r in rows] and calls == [20, 20]
