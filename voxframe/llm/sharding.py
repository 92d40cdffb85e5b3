"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 by ascending doc_id. A Feistel network over a x b,
the smallest near-square grid that covers n, permutes the numbers; a number that
lands beyond n is permuted again until it falls within. The permuted number
gives shard and slot by division, so both can be computed for any row from n
and the seed alone, and shard sizes differ by at most one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, partitions, stage, utf8

ROUNDS = 6


def number_rows(df: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """The rows with a global number `row` from 0 in the given order, and their count.

    Rows are dealt out by ranges of the order and counted in each range, so no
    task sorts all of them; the driver gets one count for each partition.
    """
    dealt = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    rows = stage(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33).cast("int")
    counts = sorted(tuple(r) for r in rows.groupBy(part.alias("p")).count().collect())
    starts, n = [], 0
    for p, count in counts:
        starts.append((p, n))
        n += count
    bases = df.sparkSession.createDataFrame(starts, "_part int, _base long")
    joined = rows.withColumn("_part", part).join(F.broadcast(bases), "_part")  # a row for each partition
    row = F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return joined.withColumn("row", row).drop("_part", "_base", "_at"), n


def grid(n: int) -> tuple[int, int]:
    """Sides a, b of the near-square grid that covers n with fewer than a cells to spare."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute(row: Column, n: int, seed: int) -> Column:
    """The place of a row number in the seeded permutation of 0..n-1.

    Fewer than a of the a x b cells lie beyond n and a walk visits each at most
    once, so the walk below is long enough: it makes that many steps, or 64
    where more cells are spare, which a walk exceeds with a chance below 1e-100;
    a place that still lies beyond n would be an error, not a wrong place.
    """
    a, b = grid(n)

    def once(x: Column) -> Column:
        def turn(state: Column, k: Column) -> Column:
            left, right = state["l"], state["r"]
            even = k % 2 == 0
            mixed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), k, F.when(even, right).otherwise(left)).cast("binary")), 1, 15), 16, 10).cast("long")
            return F.struct(F.when(even, (left + mixed) % a).otherwise(left).alias("l"), F.when(even, right).otherwise((right + mixed) % b).alias("r"))

        start = F.struct((x % a).alias("l"), ((x - x % a) / a).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] + s["r"] * a)

    steps = min(a * b - n, 64)
    first = once(row)
    if not steps:
        return first
    within = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.transform(F.array(within), lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("a walk is longer than it was given steps"))))[0]


def shard(docs: DataFrame, shards: int = 8, seed: int = 20_240_607) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Rows with equal doc_id are numbered by their text's checksum and size, so
    that equal inputs give equal results; a null doc_id comes first, a null text
    has size 1 and the checksum of no bytes. An empty table gives no rows. A very
    long text is one row like any other; other columns take no part.
    """
    data = utf8(F.col("text"))
    rows = need(docs, "doc_id", "text").select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    numbered, n = number_rows(rows, F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    place = numbered.withColumn("place", permute(F.col("row"), n, seed))
    return place.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        ((F.col("place") - F.col("place") % shards) / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row",
    )
