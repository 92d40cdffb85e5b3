"""Saved specifications of the posterior package: one record a row, brought from its version to the present one.

A record is a JSON object. A version has a fixed set of keys; each step to the
next adds what that version brought, with the values under which a renderer acts
as before. A record that doesn't fit its own version, or can't be replayed, is
refused with a reason, and never guessed at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keys of version 2 and their bounds (low, high, whether low itself is refused), numbers first and then triples.
NUMBERS = {
    "field_strength": (0.0, 20.0, True), "contrast_scale": (0.0, 1.25, True), "offset_dynamic_range": (-0.5, 0.5, False), "bridge_signal_scale": (0.0, 1.0, True), "snr_ratio": (0.0, 1.0, True), "noise_correlation_mm": (0.0, 10.0, True),
    "boundary_mix": (0.0, 1.0, False), "boundary_texture_retention": (0.0, 1.0, False), "boundary_contrast_scale": (0.0, 1.0, True), "tentorium_level": (0.0, 1.0, False), "tentorium_blend": (0.0, 1.0, False), "tentorium_thickness_mm": (0.1, 5.0, False),
    "tentorium_base_s_frac": (0.0, 1.0, False), "tentorium_slope_r": (-0.5, 0.5, False), "tentorium_slope_a": (-0.5, 0.5, False), "tentorium_curvature": (-0.5, 0.5, False), "inferior_margin_mm": (0.0, 50.0, False),
}
TRIPLES = {
    "field_center_frac_ras": (0.0, 1.0), "field_fwhm_mm_ras": (5.0, 250.0), "bridge_center_frac_ras": (0.0, 1.0), "bridge_fwhm_mm_ras": (5.0, 250.0), "psf_fwhm_mm_ras": (0.1, 10.0), "boundary_center_frac_ras": (0.0, 1.0), "boundary_field_fwhm_mm_ras": (5.0, 250.0),
    "boundary_blur_fwhm_mm_ras": (0.1, 12.0), "pose_rotation_deg_ras": (-30.0, 30.0), "pose_scale_ras": (0.75, 1.25), "pose_shift_mm_ras": (-40.0, 40.0),
}
# What each later version added: bounds, and the value that changes nothing.
STEPS = {
    3: {"render_boundary_bias_mm": (-8.0, 4.0, 0.0), "render_boundary_jitter_mm": (0.0, 4.5, 0.0), "render_boundary_correlation_mm": (5.0, 60.0, 24.0), "folial_detail_gain": (0.0, 2.0, 0.0)},
    4: {"render_boundary_coarsen_mm": (0.0, 20.0, 0.0)},
    5: {"render_boundary_floor_mix": (0.0, 1.0, 0.0)},
    6: {},
    7: {"acquisition_guard_dilation_mm": (0.0, 12.0, 0.0), "acquisition_guard_feather_mm": (0.0, 10.0, 0.0), "acquisition_transition_width_mm": (0.0, 10.0, 0.0), "boundary_confidence_floor": (0.0, 1.0, 0.0)},
}
FIRST, LAST = 2, 7
#: The next version applied a field of this one elsewhere, so its records can't be replayed.
NOT_REPLAYED = 5
_ADDED = {k: b for own in STEPS.values() for k, b in own.items()}


def keys(version: int) -> list[str]:
    """The keys of a version, in order of their names."""
    return sorted(["version", "seed", "tentorium_on", *NUMBERS, *TRIPLES, *[k for v, own in STEPS.items() if v <= version for k in own]])


def _number(fields: Column, key: str) -> Column:
    """A JSON number; null for anything else, infinities and text too."""
    text = F.try_element_at(fields, F.lit(key))
    return F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), text.try_cast("double"))


def _triple(found: Column) -> Column:
    """A JSON array, as it was read, of three finite numbers; null for anything else."""
    return F.when((F.size(found) == 3) & F.forall(found, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), found)


def _read(rows: DataFrame, fields: str = "_f") -> DataFrame:
    """Adds each value, typed, as a column `_key`: read once, however often rules look at it. Column expressions would be read anew each time."""
    rows = rows.withColumns({f"_{k}": _number(F.col(fields), k) for k in (*NUMBERS, *_ADDED)} | {f"_{k}": F.from_json(F.try_element_at(fields, F.lit(k)), "array<double>") for k in TRIPLES})
    return rows.withColumns({f"_{k}": _triple(F.col(f"_{k}")) for k in TRIPLES})


def _problems(fields: Column) -> list[tuple[Column, str]]:
    """What is wrong with a record of the last version that _read() has read, the first of which is said."""
    seed = F.try_element_at(fields, F.lit("seed"))
    out = [(~F.coalesce(seed.rlike("^[0-9]+$") & seed.try_cast("long").isNotNull(), F.lit(False)), "seed isn't a whole number from 0 on")]
    for key, (low, high, open_) in [*NUMBERS.items(), *[(k, (low, high, False)) for k, (low, high, _) in _ADDED.items()]]:
        x = F.col(f"_{key}")
        out += [(x.isNull(), f"{key} isn't a number"), ((x <= low if open_ else x < low) | (x > high), f"{key} is out of bounds")]
    out.append((~F.coalesce(F.try_element_at(fields, F.lit("tentorium_on")).isin("true", "false", "0", "1"), F.lit(False)), "tentorium_on isn't boolean"))
    for key, (low, high) in TRIPLES.items():
        t = F.col(f"_{key}")
        out += [(t.isNull(), f"{key} isn't three numbers"), (_outside(t, low, high), f"{key} is out of bounds")]
    return out


def _outside(t: Column, low: float, high: float) -> Column:
    return F.exists(t, lambda x: (x < low) | (x > high))


def migrated(records: DataFrame, text: str = "spec") -> DataFrame:
    """Adds source_version, fields (the record at version 7, typed, null if refused) and error.

    Refused are text that isn't a JSON object, an unknown version, keys that its
    version doesn't have or lacks, version 5, and values that aren't what the
    key asks for. Steps are applied in turn, each to the records that have
    reached its version. Null text is refused too; an empty table gives no rows; other columns stay.
    """
    rows = records.withColumn("_f", F.from_json(text, "map<string,string>"))
    version = F.try_element_at("_f", F.lit("version"))
    rows = rows.withColumn("source_version", F.when(version.rlike("^[0-9]{1,9}$"), version.cast("int")))
    expected = F.create_map(*[x for v in range(FIRST, LAST + 1) for x in (F.lit(v), F.array(*map(F.lit, keys(v))))])
    rows = rows.withColumn("_expected", F.try_element_at(expected, F.col("source_version")))
    of = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    own = F.map_keys("_f")
    unfit = (
        F.when(F.col("_f").isNull(), "not an object")
        .when(F.col("_expected").isNull(), "unsupported version")
        .when(F.size(F.array_except(own, "_expected")) > 0, F.concat(F.lit("unknown keys: "), of(own, F.col("_expected"))))
        .when(F.size(F.array_except("_expected", own)) > 0, F.concat(F.lit("missing keys: "), of(F.col("_expected"), own)))
        .when(F.col("source_version") == NOT_REPLAYED, "version 5 can't be replayed")
    )
    rows = rows.withColumn("error", unfit).withColumns({"_v": F.col("source_version"), "_f": F.when(F.col("error").isNull(), F.col("_f"))})
    for to, added in STEPS.items():
        here = F.col("_v") == to - 1
        more = F.create_map(*[F.lit(x) for k, (_, _, neutral) in added.items() for x in (k, str(neutral))]) if added else None
        rows = rows.withColumns({"_f": F.when(here, F.map_concat("_f", more)).otherwise(F.col("_f")) if added else F.col("_f"), "_v": F.when(here, F.lit(to)).otherwise(F.col("_v"))})
    rows = _read(rows)
    wrong = F.lit(None).cast("string")
    for bad, said in reversed(_problems(F.col("_f"))):
        wrong = F.when(bad, said).otherwise(wrong)
    rows = rows.withColumn("error", F.coalesce("error", wrong))
    fields = [F.lit(LAST).alias("version"), F.try_element_at("_f", F.lit("seed")).cast("long").alias("seed"), F.try_element_at("_f", F.lit("tentorium_on")).isin("true", "1").alias("tentorium_on")]
    fields += [F.col(f"_{k}").alias(k) for k in (*NUMBERS, *_ADDED, *TRIPLES)]
    return rows.withColumn("fields", F.when(F.col("error").isNull(), F.struct(*fields))).select(*records.columns, "source_version", "fields", "error")
