"""Saved records of all versions end as the same record; what doesn't fit is refused with its reason."""

import json

import pytest

from voxframe.plans import specifications as S


def record(of, **more):
    middle = {k: (low + high) / 2 for k, (low, high, _) in S.NUMBERS.items()}
    added = {k: neutral for v, own in S.STEPS.items() if v <= of for k, (_, _, neutral) in own.items()}
    return {"version": of, "seed": 5, "tentorium_on": True, **middle, **{k: [low, (low + high) / 2, high] for k, (low, high) in S.TRIPLES.items()}, **added} | more


def test_versions_meet_and_faults_are_said(spark):
    without = record(6)
    del without["seed"]
    cases = {
        **{f"v{v}": json.dumps(record(v)) for v in (2, 3, 4, 6, 7)}, "v5": json.dumps(record(5)), "v8": json.dumps(record(7, version=8)), "text": "nothing", "list": "[1]", "null": None, "without": json.dumps(without),
        "more": json.dumps(record(2, zeta=1, alpha=2)), "late": json.dumps(record(3, render_boundary_coarsen_mm=0.0)), "high": json.dumps(record(7, snr_ratio=1.01)), "open": json.dumps(record(7, snr_ratio=0)), "edge": json.dumps(record(7, boundary_mix=0, pose_scale_ras=[0.75, 1, 1.25])),
        "triple": json.dumps(record(4, psf_fwhm_mm_ras=[1, 2])), "wide": json.dumps(record(4, psf_fwhm_mm_ras=[1, 2, 11])), "nan": json.dumps(record(7, snr_ratio=float("nan"))), "word": json.dumps(record(7, contrast_scale="1")) .replace('"contrast_scale": "1"', '"contrast_scale": "one"'),
        "seed": json.dumps(record(7, seed=-1)), "long": json.dumps(record(7, seed=1 << 63)), "flag": json.dumps(record(7, tentorium_on=2)), "number": json.dumps(record(7, tentorium_on=0)),
    }
    table = spark.createDataFrame([(k, v, 1) for k, v in cases.items()], "id string, spec string, fields0 int")
    got = {r["id"]: r for r in S.migrated(table).collect()}
    whole = got["v7"]["fields"]
    assert all(got[f"v{v}"]["fields"] == whole for v in (2, 3, 4, 6)) and all(got[f"v{v}"]["error"] is None and got[f"v{v}"]["source_version"] == v for v in (2, 3, 4, 6, 7))
    whole = whole.asDict()
    assert whole["version"] == 7 and whole["tentorium_on"] is True and whole["render_boundary_correlation_mm"] == 24.0 and sorted(whole) == S.keys(7)
    assert whole["pose_shift_mm_ras"] == [-40.0, 0.0, 40.0] and whole["contrast_scale"] == pytest.approx(0.625)
    assert got["edge"]["error"] is None and got["number"]["fields"]["tentorium_on"] is False
    want = {
        "v5": "version 5 can't be replayed", "v8": "unsupported version", "text": "not an object", "list": "not an object", "null": "not an object", "without": "missing keys: seed", "more": "unknown keys: alpha,zeta",
        "late": "unknown keys: render_boundary_coarsen_mm", "high": "snr_ratio is out of bounds", "open": "snr_ratio is out of bounds", "triple": "psf_fwhm_mm_ras isn't three numbers", "wide": "psf_fwhm_mm_ras is out of bounds",
        "word": "contrast_scale isn't a number", "seed": "seed isn't a whole number from 0 on", "long": "seed isn't a whole number from 0 on", "flag": "tentorium_on isn't boolean",
    }
    assert {k: got[k]["error"] for k in want} == want and got["nan"]["error"] in ("snr_ratio isn't a number", "not an object") and all(got[k]["fields"] is None for k in (*want, "nan"))
    assert S.migrated(table.limit(0)).count() == 0
