"""Tables staged in the shared folder, where the lineage of iterative work ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors see.

    Unset on one machine, a folder is made and set; a cluster must name its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='voxframe-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stage(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed_stage(df: DataFrame, name: str, *aggregates: Column) -> tuple[DataFrame, tuple]:
    """stage(), and aggregates of what was written, which cost no further job."""
    seen = Observation()
    done = stage(df.observe(seen, *[a.alias(f"a{k}") for k, a in enumerate(aggregates)]), name)
    found = seen.get
    return done, tuple(found[f"a{k}"] for k in range(len(aggregates)))
