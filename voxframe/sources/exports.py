"""What a run leaves behind or pins: mask files, manifests, assets, fingerprints and settings."""

from __future__ import annotations

import hashlib
import json
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .volumes import encode_nifti


def write_masks(df: DataFrame, folder: str, protected: DataFrame | None = None) -> DataFrame:
    """Writes (output, mask, shape) as NIfTI bytes, a file name and its content in each row of a Parquet table that appears whole or not at all.

    Masks are stored as 0 and 1 on the unit grid. Outputs that repeat each other, or that are
    among `protected` (path), are refused before anything is written.
    """
    twice = df.groupBy(F.lower("output").alias("path")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not twice.isEmpty():
        raise ValueError(f"outputs repeat each other: {twice.first()['path']}")
    if protected is not None:
        clash = df.select(F.lower("output").alias("path")).join(protected.select(F.lower("path").alias("path")), "path", "left_semi")
        if not clash.isEmpty():
            raise ValueError(f"an output is an input: {clash.first()['path']}")

    @F.pandas_udf("binary")
    def encoded(mask: pd.Series, shape: pd.Series) -> pd.Series:
        return pd.Series([encode_nifti(np.asarray(m, bool).reshape(tuple(int(k) for k in s)).astype(np.uint8), np.eye(4)) for m, s in zip(mask, shape, strict=True)])

    df.select("output", encoded("mask", "shape").alias("content")).write.mode("errorifexists").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def offline_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The records of a JSON-lines manifest that have a mask."""
    return spark.read.schema("scan string, mask string").json(path).filter("mask IS NOT NULL AND mask <> ''")


def export_test_manifest(members: DataFrame, fingerprint: str, expected: str, path: str) -> None:
    """Writes the members of a test split as JSON lines, only if the recovered split is proved to be the original one and nothing is there yet."""
    if fingerprint != expected:
        raise ValueError("the split's fingerprint isn't the one that was recorded")
    members.write.mode("errorifexists").json(path)


def pinned_asset(content: bytes, asset_id: str, sha256: str) -> dict:
    """A JSON object whose bytes and id are those that were pinned."""
    if hashlib.sha256(content).hexdigest() != sha256:
        raise ValueError("the asset's bytes aren't those that were pinned")
    found = json.loads(content)
    if not isinstance(found, dict) or found.get("id") != asset_id:
        raise ValueError(f"the asset isn't {asset_id!r}")
    return found


def code_fingerprint(files: DataFrame, root: str) -> DataFrame:
    """One row: the SHA-256 over the names below `root` and contents (path, content) of all files, whatever their order."""
    name = F.regexp_replace("path", F.lit(f"^(file:)?/*{PurePosixPath(root).as_posix().lstrip('/')}/"), F.lit(""))
    each = files.select(name.alias("name"), F.sha2("content", 256).alias("content"))
    return each.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "content"))), "\n").cast("binary"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("files"))


def resume_point(history: DataFrame, run: list[str], index: str, settings: str, current: str) -> DataFrame:
    """Where each run goes on: one after its last whole step. Runs whose steps have gaps, or were made with other settings, are refused."""
    found = history.groupBy(*run).agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("low"), F.max(index).alias("high"), F.countDistinct(index).alias("steps"), F.min(settings).alias("s0"), F.max(settings).alias("s1"))
    whole = (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("steps") == F.col("n"))
    verdict = F.when(~whole, "gaps").when((F.col("s0") != F.col("s1")) | (F.col("s1") != F.lit(current)), "other settings").otherwise("resume")
    return found.select(*run, verdict.alias("verdict"), F.when(verdict == "resume", F.col("high") + 1).alias("next"))
