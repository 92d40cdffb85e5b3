"""Small systems, lag calibration and stand-in records against NumPy and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions.linear import solve
from voxframe.plans import lags
from voxframe.sources.records import next_readable


def test_systems(spark):
    """Random, badly ordered, singular, one by one, and with a null."""
    g = np.random.default_rng(3)
    systems = [g.normal(size=(n, n + 1)).tolist() for n in (1, 2, 3, 6, 6)]
    systems += [[[0.0, 1.0, 2.0], [1.0, 0.0, 3.0]], [[1e-18, 1.0, 1.0], [1.0, 1.0, 2.0]]]
    singular = [[[1.0, 2.0, 3.0], [2.0, 4.0, 6.0]], [[0.0, 0.0]], [[1.0, None, 1.0], [0.0, 1.0, 1.0]]]
    rows = spark.createDataFrame([(n, s) for n, s in enumerate(systems + singular)], "n int, a array<array<double>>").select("n", solve(F.col("a")).alias("x")).collect()
    for r in rows:
        if r["n"] < len(systems):
            a = np.array(systems[r["n"]])
            assert np.allclose(r["x"], np.linalg.solve(a[:, :-1], a[:, -1]))
        else:
            assert r["x"] is None


def test_calibration(spark):
    """Raw coefficients reach the wanted lags where no bound is met; bounds hold; a flat spectrum is singular and stays white."""
    wanted = [[0.1, 0.05, -0.1, 0.02, -0.03, 0.01], [0.9, 0.9, 0.9, 0.9, 0.9, 0.9], [0.0] * 6, None, [0.1]]
    cases = spark.createDataFrame([(n, w, 1) for n, w in enumerate(wanted)], "case int, lags array<double>, raw_n int")
    got = {r["case"]: r for r in lags.calibrated(cases, grid=16).collect()}
    f = np.fft.fftfreq(16)
    taps = np.exp(-0.5 * (np.arange(-2, 3) / lags.SIGMA) ** 2)
    line = (np.cos(2 * np.pi * f[:, None] * np.arange(-2, 3)) * taps / taps.sum()).sum(axis=1)
    w = (1 - line[:, None, None] * line[None, :, None] * line[None, None]) ** 2
    c = [np.cos(2 * np.pi * lag * f.reshape([-1 if a == axis else 1 for a in range(3)])) * np.ones((16, 16, 16)) for axis, lag in lags.LAGS]
    for n in (0, 2):
        raw = np.array(got[n]["raw"])
        spectrum = w * (1 + 2 * sum(r * x for r, x in zip(raw, c, strict=True)))
        reached = [(spectrum * x).mean() / spectrum.mean() for x in c]
        assert np.allclose(reached, got[n]["achieved"]) and got[n]["residual"] < 1e-9
        if np.abs(raw).max() < lags.RAW and 2 * np.abs(raw).sum() < lags.BOUND:
            assert np.allclose(reached, wanted[n])
    assert np.abs(got[1]["raw"]).max() <= lags.RAW and 2 * np.abs(got[1]["raw"]).sum() <= lags.BOUND + 1e-12
    assert all(got[n]["raw"] is None and got[n]["achieved"] is None and got[n]["residual"] is None for n in (3, 4))
    flat = lags.calibrated(cases.limit(1), grid=1).first()
    assert flat["raw"] == [0.0] * 6


@pytest.mark.parametrize("size", [2, 3, 5, 1000])
def test_stand_in_records(spark, size):
    """Runs of bad records within, at the ends of and across buckets; gaps, repeated and null places; nothing readable."""
    good = {4: True, 5: False, 6: False, 7: None, 30: False, 31: True, 32: False, 47: False, 12: True, 13: False}
    rows = [(k, v, "x") for k, v in good.items()] + [(32, True, "again"), (None, True, "null")]
    table = spark.createDataFrame(rows, "idx long, readable boolean, found string")
    got = {(r["idx"], r["found"]): r["stand_in"] for r in next_readable(table, size=size).collect()}
    fine = sorted(k for k, v, _ in rows if v and k is not None)
    assert got == {(k, n): None if k is None else next((x for x in fine if x >= k), fine[0]) for k, _, n in rows}
    assert {r["stand_in"] for r in next_readable(table.withColumn("readable", F.lit(False)), size=size).collect()} == {None}
    assert next_readable(table.limit(0), size=size).count() == 0
