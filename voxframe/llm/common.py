"""What the operators of this package share: the shared folder, staged tables, names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a character class body for Java, RE2 and Python regexes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as spark.checkpoint.dir names it.

    Only where that setting is absent (tests on one machine) a temporary folder
    is made; a cluster without the setting is refused, since a local folder
    would be invisible to its executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='voxframe-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there,
    so what comes later survives the loss of any executor without recomputing it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed_stage(df: DataFrame, name: str, *aggregates: Column) -> tuple[DataFrame, tuple]:
    """stage(), and aggregates of what was written, which cost no further job."""
    seen = Observation()
    done = stage(df.observe(seen, *[a.alias(f"a{k}") for k, a in enumerate(aggregates)]), name)
    found = seen.get
    return done, tuple(found[f"a{k}"] for k in range(len(aggregates)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def need(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns by their exact names, so that other columns, whose
    names may clash with the operator's own, take no part."""
    return df.select(*[quoted(n) for n in names])


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> DataFrame:
    """All columns as the fields of one column `row`, so that no name of the operator's own can clash with theirs."""
    return df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of packed() again, those in `changed` anew."""
    return df.select(*[(changed or {}).get(c, F.col("row").getField(c)).alias(c) for c in columns])


#: A key that has more than this share of a table's rows is met by broadcast; fewer than 1 / HOT_SHARE keys can.
HOT_SHARE = 0.002
#: Rows that one task joins at ease, whatever their keys.
EASY_ROWS = 20_000


def hot_keys(big: DataFrame, on: list[str], counts: DataFrame | None = None) -> list[int]:
    """Hashes of the keys with more than HOT_SHARE of the rows of a staged table; `counts` (on, rows) if it's known already."""
    total = big.count()
    if total <= EASY_ROWS:
        return []
    counts = big.groupBy(on).agg(F.count(F.lit(1)).alias("rows")) if counts is None else counts
    return [r[0] for r in counts.filter(F.col("rows") > total * HOT_SHARE).select(F.xxhash64(*on)).collect()]


def join_hot(big: DataFrame, small: DataFrame, on: list[str], hot: list[int], how: str = "inner") -> DataFrame:
    """big.join(small, on), where `small` has one row for each key and `big` very many for the `hot` ones.

    The rows of `small` for these, fewer than 1 / HOT_SHARE, are broadcast; in
    the join that is left no key has more than that share of the rows.
    """
    if not hot:
        return big.join(small, on, how)
    is_hot = F.xxhash64(*on).isin(hot)
    near = big.filter(is_hot).join(F.broadcast(small.filter(is_hot)), on, how)
    return near.unionByName(big.filter(~is_hot).join(small.filter(~is_hot), on, how))


def utf8(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
