"""Scores of predictions, their summaries, and what a trial log adds up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S

COUNTS = ("tp", "fp", "fn", "tn")


def scored(df: DataFrame) -> DataFrame:
    """Counts tp, fp, fn, tn to dice, iou, precision, recall."""
    c = {k: F.col(k) for k in COUNTS}
    return df.withColumns({"dice": S.dice(c["tp"], c["fp"], c["fn"]), "iou": S.iou(c["tp"], c["fp"], c["fn"]), "precision": S.precision(c["tp"], c["fp"]), "recall": S.recall(c["tp"], c["fn"])})


def evaluate(volumes: DataFrame, prediction: str = "prediction", reference: str = "mask") -> DataFrame:
    """Confusion counts and scores of each row, within the row."""
    return scored(volumes.withColumn("_c", S.confusion(F.col(prediction), F.col(reference))).select("*", "_c.*").drop("_c"))


def macro(df: DataFrame, *by: str, metrics=("dice", "iou", "precision", "recall")) -> DataFrame:
    """Mean, population deviation and number of defined values of each metric, over rows that aren't failed."""
    out = []
    for m in metrics:
        out += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), F.count(m).alias(f"{m}_defined")]
    return df.groupBy(*by).agg(*out)


def micro(df: DataFrame, *by: str) -> DataFrame:
    """Counts are summed first and scored once."""
    return scored(df.groupBy(*by).agg(*[F.sum(k).alias(k) for k in COUNTS]))


def five_number(df: DataFrame, value: str, *by: str) -> DataFrame:
    """mean, std, median, min, 10th percentile and the share of at least 0.99; null for no value."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.min(v).alias("min"),
        F.expr(f"percentile({value}, 0.1)").alias("p10"), F.avg((v >= 0.99).cast("double")).alias("share_99"),
    )


def case_balanced(trials: DataFrame, plan: DataFrame, *group: str) -> DataFrame:
    """Means over repeats, then conditions, then cases. A case counts in mean_score only if all its planned
    trials are ok; available_score takes what there is.

    trials(case, condition, repeat, status, score), plan(case, condition, repeat, *group); one row for each group.
    """
    key = ["case", "condition", "repeat"]
    rows = plan.join(trials, key, "left")
    ok = F.when(F.col("status") == "ok", F.col("score"))
    per_condition = rows.groupBy(*group, "case", "condition").agg(
        F.avg(ok).alias("score"), F.count(F.lit(1)).alias("expected"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "unchanged").alias("unchanged"), F.count_if(F.col("status").isNull()).alias("pending")
    )
    counts = ("expected", "ok", "failed", "unchanged", "pending")
    per_case = per_condition.groupBy(*group, "case").agg(F.avg("score").alias("score"), *[F.sum(c).alias(c) for c in counts])
    complete = F.col("ok") == F.col("expected")
    return per_case.groupBy(*group).agg(F.avg(F.when(complete, F.col("score"))).alias("mean_score"), F.avg("score").alias("available_score"), F.count_if(complete).alias("complete_cases"), F.count(F.lit(1)).alias("cases"), *[F.sum(c).alias(c) for c in counts])


def report_status(failed: Column, unchanged: Column, pending: Column) -> Column:
    return F.when(pending > 0, "interrupted").when(failed > 0, "completed_with_failures").when(unchanged > 0, "completed_with_unchanged_trials").otherwise("completed")


def review_flags(mask_fraction: Column, dropped_component: Column, max_fraction: float = 0.75) -> Column:
    """The reasons for a second look, joined by commas; null if there are none."""
    reasons = F.concat_ws(",", F.when(mask_fraction == 0, "empty"), F.when((mask_fraction > 0) & (mask_fraction < 0.02), "undersize"), F.when(mask_fraction > max_fraction, "oversize"), F.when(dropped_component, "dropped_component"))
    return F.nullif(reasons, F.lit(""))
