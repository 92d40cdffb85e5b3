"""What a simulated scan is acquired with: keyed draws of field, sequence, vendor, reconstruction and site style."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.draws import choice, uniform

# The options, in order, and the weights of the high fields and of the site styles.
SEQUENCES = ("MPRAGE", "MP2RAGE", "SPGR", "TSE_T2", "SPACE_T2", "FLAIR", "STIR", "DIR", "PSIR", "GRE_SWI")
FIELDS = (0.064, 0.55, 1.5, 3.0, 5.0, 7.0, 9.4, 10.5, 11.7)
HIGH_FIELDS = {"3.0": 0.50, "5.0": 0.05, "7.0": 0.42, "9.4": 0.015, "10.5": 0.010, "11.7": 0.005}
VENDORS = ("Siemens", "GE", "Philips", "Canon", "UnitedImaging", "Fujifilm")
RECONSTRUCTIONS = ("none", "GRAPPA", "SENSE", "SMS", "CompressedSensing", "DLRecon")
SITE_STYLES = {"canonical": 0.20, "unit1": 0.35, "high_contrast": 0.20, "grainy": 0.25}
SITE_ALIASES = {"clean": "canonical", "normal": "unit1", "normal_unit1": "unit1", "high-contrast": "high_contrast", "screenshot": "grainy", "screenshot_like": "grainy"}


def _even(names) -> dict[str, float]:
    return {str(n): 1.0 for n in names}


def acquisition(seed: int, case: Column, sequence: Column | None = None) -> Column:
    """struct(field, sequence, vendor, recon) of a case. MP2RAGE takes the high fields by their weights, other sequences any field alike."""
    s = choice(uniform(seed, case, "sequence"), _even(SEQUENCES)) if sequence is None else sequence
    u = uniform(seed, case, "field")
    field = F.when(s == "MP2RAGE", choice(u, HIGH_FIELDS)).otherwise(choice(u, _even(FIELDS))).cast("double")
    return F.struct(field.alias("field"), s.alias("sequence"), choice(uniform(seed, case, "vendor"), _even(VENDORS)).alias("vendor"), choice(uniform(seed, case, "recon"), _even(RECONSTRUCTIONS)).alias("recon"))


def site_style(seed: int, case: Column, given: str | None = None, clean: bool = False) -> Column:
    """struct(style, strength): drawn by weight, or as given (aliases too); grain has a strength from 0.25 to 1, others 0."""
    if clean:
        return F.struct(F.lit("canonical").alias("style"), F.lit(0.0).alias("strength"))
    if given is not None:
        name = given.strip().lower().replace(" ", "_")
        name = SITE_ALIASES.get(name, name)
        if name not in SITE_STYLES:
            raise ValueError(f"unknown site style {given!r}")
        style = F.lit(name)
    else:
        style = choice(uniform(seed, case, "style"), SITE_STYLES)
    return F.struct(style.alias("style"), F.when(style == "grainy", 0.25 + 0.75 * uniform(seed, case, "grain")).otherwise(0.0).alias("strength"))


def contrast_temperature(x: Column, gain: float) -> Column:
    """The logit of x times the gain: values move away from 1/2 (gain above 1) or towards it, in order."""
    q = F.least(F.greatest(x, F.lit(1e-5)), F.lit(1 - 1e-5))
    return 1.0 / (1.0 + F.exp(-gain * F.log(q / (1.0 - q))))


def monotone_envelope(values: Column) -> Column:
    """The running maximum of an array."""
    start = F.struct(F.lit(float("-inf")).alias("top"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(values, start, lambda a, x: F.struct(F.greatest(a["top"], x).alias("top"), F.concat(a["out"], F.array(F.greatest(a["top"], x))).alias("out")), lambda a: a["out"])


def tied_knots(source: Column, target: Column) -> Column:
    """array<struct(x, y)>: the distinct source values with the mean target of each, made monotone."""
    pairs = F.arrays_zip(source.alias("x"), target.alias("y"))
    xs = F.array_sort(F.array_distinct(source))
    mean = lambda x: F.aggregate(F.filter(pairs, lambda p: p["x"] == x), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, p: F.struct((a["s"] + p["y"]).alias("s"), (a["n"] + 1).alias("n")), lambda a: a["s"] / a["n"])
    return F.zip_with(xs, monotone_envelope(F.transform(xs, mean)), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
