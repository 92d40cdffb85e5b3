"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its share of all tokens to the power alpha, normalised.
alpha = 1 leaves the shares as they are, alpha = 0 makes all sources equal; the
exponent is bisected to a target entropy, and to the flattest mix in which no
source is repeated more than `max_epochs` times. The budget is the smallest at
which every source is used whole at least once, so no document is lost and small
sources are repeated. Each pass over a source is a seeded permutation of its
documents, each block of the mix takes tokens from every source by weight, and
the documents of a block are permuted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, need, packed, stage, unpacked

#: More sources are refused: their token counts are weighed on the driver and sent to every task.
MAX_SOURCES = 100_000
#: Documents of a source in a bucket, on average, of those whose tokens are summed by one task.
BUCKET_ROWS = 4096


def weights(tokens: dict, alpha: float) -> dict:
    total = sum(tokens.values())
    raw = {s: (n / total) ** alpha for s, n in sorted(tokens.items())}
    norm = math.fsum(raw.values())
    return {s: w / norm for s, w in raw.items()}


def epochs(tokens: dict, alpha: float) -> dict:
    """Passes over each source at the smallest budget that uses every source once."""
    w = weights(tokens, alpha)
    rate = {s: w[s] / n for s, n in tokens.items()}
    least = min(rate.values())
    return {s: r / least for s, r in rate.items()}


def entropy(w: dict) -> float:
    return -math.fsum(x * math.log(x) for x in w.values() if x > 0)


def solve_alpha(tokens: dict, max_epochs: float | None = None, target_entropy: float | None = None, entropy_gain: float | None = None, steps: int = 50) -> float:
    """The exponent in [0, 1], to nine decimals: the least that keeps every source within
    `max_epochs`, and the greatest that reaches the target entropy.

    The target is `target_entropy`, a share of the entropy of equal weights, or
    `entropy_gain`, the share of the way from the sources' own entropy to that of
    equal weights. If limit and target are given, the limit prevails. Sources
    without tokens take no part. Fewer than two sources: 1.
    """
    tokens = {s: n for s, n in tokens.items() if n > 0}
    if len(tokens) < 2:
        return 1.0

    def bisect(holds_above) -> float:
        """The least alpha, to 2**-steps, from which on it holds; it holds at 1."""
        low, high = 0.0, 1.0
        if holds_above(low):
            return low
        for _ in range(steps):
            middle = (low + high) / 2
            low, high = (low, middle) if holds_above(middle) else (middle, high)
        return high

    floor = bisect(lambda a: max(epochs(tokens, a).values()) <= max_epochs) if max_epochs else 0.0
    own, flat, goal = entropy(weights(tokens, 1.0)), math.log(len(tokens)), None
    if target_entropy is not None:
        goal = target_entropy * flat
    elif entropy_gain is not None:
        goal = own + entropy_gain * (flat - own)
    if goal is None:
        return round(floor, 9)
    return round(1.0 if own >= goal else max(floor, bisect(lambda a: entropy(weights(tokens, a)) < goal)), 9)


def _order(seed: int, *parts: Column) -> Column:
    """A place in [0, 2**60) from the parts' digest."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _text_md5() -> Column:
    """Of the UTF-8 text; null for a null text."""
    return F.md5(F.encode(F.col("text"), "UTF-8"))


def units(docs: DataFrame) -> DataFrame:
    """What is mixed: doc_id, source, text_md5, tokens of a copy, copies. Equal rows are one unit."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return (
        need(docs, "doc_id", "text", "source")
        .select("doc_id", "source", _text_md5().alias("text_md5"), (words + 1).alias("tokens"))
        .groupBy("doc_id", "source", "text_md5", "tokens")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def mix(docs: DataFrame, max_epochs: float = 2.0, target_entropy: float | None = None, entropy_gain: float | None = None, block_tokens: int = 100_000, seed: int = 9) -> DataFrame:
    """Each use of each document in the mix: doc_id, source, text_md5, copies, tokens,
    epoch, alpha, weight, target_tokens, stream_start (tokens of its source before
    it), block and slot (its place in the block's permutation, gapless from 0).

    A document's tokens are its words between ASCII white space and one more for
    its end, so every document has some. A document is used in the first pass and
    in each further pass whose budget isn't used up before it, so a source
    exceeds its budget by less than one document. A null source is a source of
    its own, apart from ''; a null text has no words. Equal rows are one unit
    with `copies` and one slot. Very long documents are one unit too and may
    leave a block to fewer sources. An empty table gives no rows; more than
    MAX_SOURCES sources are refused. Other columns take no part.
    """
    spark = docs.sparkSession
    found = stage(units(docs), "units")
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    sizes = found.groupBy(key.alias("k")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n"))
    held = sizes.limit(MAX_SOURCES + 1).collect()
    if len(held) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    size = {(r["k"]["none"], r["k"]["name"]): (r["tokens"], r["n"]) for r in held}
    having = {s: n for s, (n, _) in size.items()}
    alpha = solve_alpha(having, max_epochs, target_entropy, entropy_gain)
    w, passes = (weights(having, alpha), epochs(having, alpha)) if having else ({}, {})
    # Whole numbers from here on: floating-point noise must not start another pass or move a block.
    table = [(*s, n, round(w[s], 12), round(passes[s] * 10**6), max(1, int(round(w[s], 12) * block_tokens)), 1 + rows // BUCKET_ROWS) for s, (n, rows) in size.items()]
    budget = spark.createDataFrame(table, "none boolean, name string, available long, weight double, millionths long, share long, buckets int")

    joined = found.withColumn("none", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit(""))).join(F.broadcast(budget), ["none", "name"])  # MAX_SOURCES rows at most
    last = F.greatest(F.ceil(F.col("millionths") / 10**6).cast("int"), F.lit(1)) - 1
    used = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    used = used.withColumn("h", _order(seed, F.col("doc_id"), F.col("text_md5"), F.col("epoch")))
    used = used.withColumn("bucket", F.floor(F.col("h") / float(1 << 60) * F.col("buckets")).cast("int"))
    of_bucket = ["none", "name", "epoch", "bucket"]
    # Tokens before each bucket, then before each document in its bucket: no window holds a whole source.
    sums = used.groupBy(of_bucket).agg(F.sum(F.col("tokens") * F.col("copies")).alias("in_bucket"))
    before = sums.selectExpr(*of_bucket, "sum(in_bucket) OVER (PARTITION BY none, name, epoch ORDER BY bucket) - in_bucket AS before")
    used = used.join(before, of_bucket)
    within = "sum(tokens * copies) OVER (PARTITION BY none, name, epoch, bucket ORDER BY h, doc_id, text_md5) - tokens * copies"
    used = used.withColumn("stream_start", F.expr(f"epoch * available + before + {within}"))
    target = F.expr("available * millionths div 1000000").cast("long")
    used = used.withColumn("target_tokens", target).filter((F.col("epoch") == 0) | (F.col("stream_start") < F.col("target_tokens")))
    used = used.withColumn("block", F.expr("stream_start div share").cast("long"))
    # A block holds about block_tokens tokens, and a document one at least.
    used = used.withColumn("at", _order(seed + 1, F.col("block"), F.col("doc_id"), F.col("text_md5"), F.col("epoch")))
    place = Window.partitionBy("block").orderBy("at", "doc_id", "text_md5", "none", "name", "epoch")
    return used.select(
        "doc_id", "source", "text_md5", "copies", "tokens", F.col("epoch").cast("int").alias("epoch"), F.lit(alpha).alias("alpha"), "weight", "target_tokens", "stream_start", "block",
        (F.row_number().over(place) - 1).cast("long").alias("slot"),
    )


def mixed_documents(docs: DataFrame, max_epochs: float = 2.0, target_entropy: float | None = None, entropy_gain: float | None = None, seed: int = 9) -> DataFrame:
    """The documents of the mix, each as often as it is used, all columns as they were, whatever their names.

    Nulls, repeated rows and empty tables: as mix() has them. Every row is there once at least.
    """
    found = mix(docs, max_epochs, target_entropy, entropy_gain, seed=seed)
    uses = found.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("text_md5").alias("md5")).agg(F.count(F.lit(1)).alias("uses"))
    row = F.col("row")
    rows = packed(docs).withColumn("own", F.md5(F.encode(row["text"], "UTF-8")))
    same = row["doc_id"].eqNullSafe(F.col("id")) & row["source"].eqNullSafe(F.col("of")) & F.col("own").eqNullSafe(F.col("md5"))
    again = rows.join(uses, same).withColumn("use", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    return unpacked(again, docs.columns)
