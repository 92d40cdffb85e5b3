"""Queries against DuckDB on the smallest tables."""

import duckdb
import pytest

from voxframe.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["dice_per_volume", "macro_metrics", "micro_metrics", "case_balanced_summary", "subject_split", "split_fingerprint", "recovery_merge", "trial_plan", "trial_seed_hex", "route_mixed", "vol_clipping", "vol_ghosting", "vol_rician_noise", "vol_dropout", "otsu_threshold", "orientation_roundtrip", "surface_losses", "crop_boundary", "normalisation_region", "style_descriptor", "hard_tail_verdicts", "effect_metrics", "batch_gate", "full_mix_choice", "vol_chemical_shift", "vol_t2_remap", "vol_motion_blur", "vol_zipper", "largest_component", "postprocess_mask", "rendered_trials", "kmeans_labels", "stage_sequences", "block_signed_distance", "block_component_sizes", "vol_motion", "lag_calibration", "conformed_volumes", "migrated_specifications", "operators_catalogue", "style_search", "sample_run"]


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("~" if r[i] is None else f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal(df.collect(), df.columns) == normal(want.fetchall(), want.columns)


def test_every_operator_has_a_query():
    from voxframe.operators import OPERATORS

    assert {f"vol_{n}" for n in OPERATORS} <= set(QUERIES)
    assert set(ORACLE_SQL) <= set(QUERIES)
