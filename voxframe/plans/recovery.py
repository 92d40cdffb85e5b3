"""Checks of trial logs against their plan, and the merge of repeated trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def problems(plan: DataFrame, rows: DataFrame, key: list[str], parts: int | None = None) -> DataFrame:
    """(key, problem): 'outside' the plan, 'duplicate' or 'missing'. Counted in one shuffle, into so many parts if they are given.

    Most keys come once or twice, so with `parts` nothing is counted before the shuffle, where it would hold nearly all rows.
    """
    both = plan.select(*key, F.lit(1).alias("p"), F.lit(0).alias("r")).unionByName(rows.select(*key, F.lit(0).alias("p"), F.lit(1).alias("r")))
    both = both if parts is None else both.repartition(parts, *key)
    n = both.groupBy(*key).agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    what = F.when(F.col("p") == 0, "outside").when(F.col("r") > 1, "duplicate").when(F.col("r") == 0, "missing")
    return n.select(*key, what.alias("problem")).filter("problem IS NOT NULL")


def merge(original: DataFrame, retried: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The original rows, those retried replaced; `origin` says which."""
    new = retried.select(*key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = original.join(new, key, "left")
    took = F.col("_new").isNotNull()
    return out.select(*key, *[F.when(took, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns], F.when(took, "retried").otherwise("original").alias("origin"))


def accounting(original: DataFrame, merged: DataFrame, key: list[str]) -> DataFrame:
    """How many trials were retried, recovered, failed again, became unchanged, and were kept."""
    both = merged.select(*key, F.col("status").alias("now"), "origin").join(original.select(*key, F.col("status").alias("was")), key)
    hit = lambda c: F.count_if(c)
    return both.agg(
        hit(F.col("origin") == "retried").alias("retried"), hit((F.col("was") == "failed") & (F.col("now") == "ok")).alias("recovered"), hit((F.col("was") == "failed") & (F.col("now") == "unchanged")).alias("failed_to_unchanged"),
        hit((F.col("origin") == "original") & (F.col("now") == "ok")).alias("retained_ok"), hit((F.col("origin") == "original") & (F.col("now") == "unchanged")).alias("retained_unchanged"),
    )


def backoff_valid(steps: DataFrame, run: list[str], order: list[str], before: str, after: str) -> DataFrame:
    """Whether each step of a run starts where the last one ended and halves it (4, 2, 1)."""
    w = Window.partitionBy(*run).orderBy(*order)
    last = F.lag(after).over(w)
    ok = (F.col(after) * 2 == F.col(before)) & (last.isNull() | (last == F.col(before)))
    return steps.withColumn("_ok", ok).groupBy(*run).agg(F.min("_ok").alias("valid"), F.count(F.lit(1)).alias("steps"))


def attempts_valid(attempts: DataFrame, run: list[str], number: str, order: list[str]) -> DataFrame:
    """Whether attempts are numbered by their place from 1."""
    w = Window.partitionBy(*run).orderBy(*order)
    return attempts.withColumn("_ok", F.row_number().over(w) == F.col(number)).groupBy(*run).agg(F.min("_ok").alias("valid"), F.count(F.lit(1)).alias("attempts"))


def contiguous(history: DataFrame, run: list[str], index: str, first: int = 0) -> DataFrame:
    """Whether a run's indices are first, first + 1, ... without gap or repeat: an aggregate, no window."""
    n, low, high, different = F.count(F.lit(1)), F.min(index), F.max(index), F.countDistinct(index)
    return history.groupBy(*run).agg(n.alias("n"), ((low == first) & (high == first + n - 1) & (different == n)).alias("contiguous"))


def best(history: DataFrame, run: list[str], score: str, index: str) -> DataFrame:
    """The earliest index with a run's greatest score."""
    return history.groupBy(*run).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(index)).alias("i"))).alias("b")).select(*run, F.col("b.s").alias("best_score"), (-F.col("b.i")).alias("best_index"))


def constant_settings(rows: DataFrame, run: list[str], settings: list[str]) -> DataFrame:
    """Settings that vary within a run, joined by commas; null if none does."""
    varied = [F.when(F.coalesce(F.min(s) != F.max(s), F.lit(False)) | (F.count(s) != F.count(F.lit(1))) & (F.count(s) > 0), s) for s in settings]
    return rows.groupBy(*run).agg(F.nullif(F.concat_ws(",", *varied), F.lit("")).alias("varied"))
