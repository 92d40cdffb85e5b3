"""Subject-safe splits, copy collapse, fingerprints and preflight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws


def subject_split(subjects: DataFrame, key: str, test: float, val: float, seed: int) -> DataFrame:
    """Each distinct subject in train, val or test, by the order of a hash of seed and subject.

    n_test = half-even round(test * n), at most n - 2; n_val at least 1 and such
    that one stays for training. Fewer than two subjects raise. The two cuts are
    the hashes at these ranks, found by counting, so no task orders all subjects.
    """
    rows = subjects.select(key).distinct().withColumn("h", F.sha2(draws.key(seed, F.col(key)).cast("binary"), 256))
    n = rows.count()
    if n < 2:
        raise ValueError("a split needs two subjects")
    n_test = max(0, min(round(test * n), n - 2))
    n_val = max(1, min(round(val * n), n - n_test - 1))
    cuts = {r: _nth(rows, r) for r in {n_test, n_test + n_val}}
    below = lambda r: F.lit(False) if r == 0 else F.col("h") <= cuts[r]
    split = F.when(below(n_test), "test").when(below(n_test + n_val), "val").otherwise("train")
    return rows.select(key, split.alias("split"))


def _nth(rows: DataFrame, rank: int, buckets: int = 4096) -> str:
    """The hash at a rank from 1: the bucket of leading digits is found by counts, then only that bucket is ordered."""
    if rank == 0:
        return ""
    prefix, before = "", 0
    while True:
        own = rows.filter(F.col("h").startswith(prefix)) if prefix else rows
        if prefix and own.limit(10_001).count() <= 10_000:
            return own.orderBy("h").select("h").limit(rank - before).agg(F.max("h")).first()[0]
        size = len(prefix) + 3  # 4096 buckets of three hexadecimal digits
        for p, c in sorted(map(tuple, own.groupBy(F.substring("h", 1, size)).count().collect())):
            if before + c >= rank:
                prefix = p
                break
            before += c


def split_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Subjects in both: must be empty."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def copy_collapse(rows: DataFrame, identity: list[str], content: str, order: str) -> DataFrame:
    """One row for each identity, the first by `order`; `copies`, and whether all contents are equal."""
    return rows.groupBy(*identity).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"), (F.min(content) == F.max(content)).alias("identical"))


def fingerprint(members: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One SHA-256 for each group over its sorted members, each hashed by itself first.

    Members' digests are added up as numbers before the last hash, so a group of
    any size is an aggregate that starts within the tasks; order and partitioning
    don't matter, and any changed, added or missing member changes it.
    """
    member = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]).cast("binary"), 256)
    parts = [F.conv(F.substring(member, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)") for k in range(8)]
    sums = [F.sum(p).alias(f"s{k}") for k, p in enumerate(parts)]
    out = members.groupBy(*by).agg(*sums, F.count(F.lit(1)).alias("members"))
    text = F.concat_ws(":", "members", *[F.col(f"s{k}").cast("string") for k in range(8)])
    return out.select(*by, "members", F.sha2(text.cast("binary"), 256).alias("fingerprint"))


def preflight(rows: DataFrame, good: Column, *by: str) -> DataFrame:
    """How many records are readable; 'abort' if none or more than half are bad."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(good, F.lit(False))).alias("bad"))
    return out.withColumn("verdict", F.when((F.col("n") == F.col("bad")) | (2 * F.col("bad") > F.col("n")), "abort").otherwise("go"))


def same_grid(a_shape: Column, a_affine: Column, b_shape: Column, b_affine: Column, tolerance: float = 1e-4) -> Column:
    """Equal shapes, and affines within the tolerance."""
    return (a_shape == b_shape) & F.forall(F.zip_with(a_affine, b_affine, lambda x, y: F.abs(x - y) <= tolerance), lambda ok: ok)
