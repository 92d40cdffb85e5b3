"""The benchmark's conditions, trial plans, subsets and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import json_string, trial_seed_hex
from ..operators import OPERATORS

#: The tiers in order, and the conditions that are no registered operators.
TIERS = ("clean", "mild", "protocols", "full")
MILD = ("rotation", "resize", "resolution", "mild_mix")
#: Acquisition sequences of the protocol tier besides the two registered renderers.
SEQUENCES = ("MPRAGE", "MP2RAGE", "SPGR", "TSE_T2", "SPACE_T2", "FLAIR", "STIR", "DIR", "PSIR", "GRE_SWI")
PROTOCOL_OPERATORS = ("t2_3d", "mp2rage_3d")
COMPOSITE = ("morphology", "label_synthesis", "realistic_appearance", "full_mix")


def severity_for(name: str, low: float = 0.15, high: float = 0.45) -> tuple[float, float]:
    """The requested range, capped by the registry's and the training range's ceiling."""
    o = OPERATORS[name]
    top = min(high, o.severity[1], o.train[1] if o.train else high)
    return min(low, top), top


def excluded_reason(name: str) -> str | None:
    o = OPERATORS[name]
    if name == "metal":
        return "moves anatomy"
    if o.kind == "meta":
        return "not an imaging effect"
    if o.dims == "2d":
        return "for single slices"
    if not o.label_preserving:
        return "changes the label"
    return None


def specs() -> list[tuple[str, str, str, float | None, float | None]]:
    """(name, tier, kind, low, high) of every condition, in order."""
    out: list[tuple] = [("clean", "clean", "clean", None, None)]
    out += [(n, "mild", "spatial", None, None) for n in MILD]
    out += [(n, "protocols", "sequence", None, None) for n in SEQUENCES]
    for name in OPERATORS:
        if not excluded_reason(name):
            tier = "protocols" if name in PROTOCOL_OPERATORS else "full"
            out.append((name, tier, "operator", *((1.0, 1.0) if tier == "protocols" else severity_for(name))))
    return out + [(n, "full", "composite", None, None) for n in COMPOSITE]


def build_catalog(spark: SparkSession) -> DataFrame:
    rows = [(*s, k) for k, s in enumerate(specs())]
    return spark.createDataFrame(rows, "name string, tier string, kind string, sev_lo double, sev_hi double, ord int")


def excluded(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, r) for n in OPERATORS if (r := excluded_reason(n))], "name string, reason string")


def tier_order(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier) - 1


def cumulative_tiers(conditions: DataFrame) -> DataFrame:
    """Each tier with its members: clean alone, and for the others every condition up to it but clean. conditions(name, tier)."""
    order = F.create_map(*[x for k, t in enumerate(TIERS) for x in (F.lit(t), F.lit(k))])
    upto = F.explode(F.filter(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for k, t in enumerate(TIERS)]), lambda s: s["k"] >= order[F.col("tier")]))
    rows = conditions.withColumn("in", upto)
    return rows.filter((F.col("tier") != "clean") | (F.col("in.t") == "clean")).select(F.col("in.t").alias("summary_tier"), "name", "tier")


def trial_plan(cases: DataFrame, conditions: DataFrame, repeats: int) -> DataFrame:
    """Every case under every condition, `repeats` times (once if clean): a plan, its size being what it asks for.

    Conditions are few (the catalogue), so they are put into each case's row.
    """
    listed = [tuple(r) for r in conditions.select("name", "tier").collect()]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), F.lit(t).alias("tier")) for n, t in listed]))
    rows = cases.withColumn("_c", each).select("case", "_c.*")
    last = F.when(F.col("condition") == "clean", 0).otherwise(repeats - 1)
    return rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), last)))


def trial_seed(seed: int, case: Column, condition: Column, repeat: Column) -> Column:
    return trial_seed_hex(F.lit(str(seed)), json_string(case), json_string(condition), repeat.cast("string"))


def case_subset(cases: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k cases by the SHA-256 of seed and id, whatever the order of the rows."""
    return cases.withColumn("subset_key", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256)).orderBy("subset_key", key).limit(k)
