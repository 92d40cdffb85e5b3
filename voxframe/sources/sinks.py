"""Writers: tables that appear whole or not at all, and JSON without NaN."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, as JSON has neither."""
    inf = float("inf")
    fixed = {f.name: F.when(~F.isnan(f.name) & (F.abs(f.name) < inf), F.col(f.name)) for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.withColumns(fixed) if fixed else df


def write_report(trials: DataFrame, summary: DataFrame, folder: str, overwrite: bool = False) -> None:
    """cases and summary as CSV and results as JSON, each by Spark's committer; existing folders are refused unless overwritten."""
    mode = "overwrite" if overwrite else "errorifexists"
    flat = [c for c, t in trials.dtypes if not t.startswith(("array", "struct", "map"))]
    without_nan(trials).write.mode(mode).json(f"{folder}/results")
    without_nan(trials).select(*flat).write.mode(mode).option("header", True).csv(f"{folder}/cases")
    without_nan(summary).write.mode(mode).option("header", True).csv(f"{folder}/summary")


def append_journal(rows: DataFrame, folder: str) -> None:
    """Records are added; what is there stays."""
    without_nan(rows).write.mode("append").json(folder)
