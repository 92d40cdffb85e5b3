"""Quality rules: word and line statistics, and lines that many documents of a host share.

A host is a value of `source`. Lines are normalised (lower case, one space
between words) and hashed; a line is above the limit if it stands in more
documents of its host than the larger of MAX_DOCS and MAX_SHARE of the host, so
that a verdict doesn't depend on how much data there is. A document loses such a
line if an earlier document of the host that stays has it, so what is copied is
thinned out and each line that is removed still stands somewhere. A document of
which too little remains, by the base rule's own least number of words, is
rejected as depleted. filter_documents() removes the lines from the texts that stay.

"Earlier that stays" is settled in rounds, from a host's first document on. A
round decides every document whose verdict is the same whether its undecided
lines go or stay, so common boilerplate takes two or three, and the first
undecided document of a host is always decided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, need, observed_stage, packed, stage, unpacked

_SYMBOLS, _SPACE = b"#*$%&|<>", " \t\n\v\f\r"
#: A line is above the limit in more documents than this, and than this share of its host's.
MAX_DOCS, MAX_SHARE = 5, 0.01
#: Depleted: fewer words than this remain, or fewer than so many hundredths.
LEFT_WORDS, LEFT_PERCENT = 50, 30
#: A line that makes up more than this share of all lines of documents is met by broadcast; fewer than 1 / HOT_SHARE can.
HOT_SHARE = 0.001
MIN_WORDS, REPEAT_PERCENT = 50, 50


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def _line_hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def measure(text: str) -> tuple[int, int, int, int, int, dict[int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words of each normalised line by its hash.

    Bytes are split at ASCII white space and lower-cased in ASCII only.
    """
    data = text.encode()
    words, dup, seen, lines = data.split(), 0, set(), {}
    for line in data.split(b"\n"):
        if own := line.lower().split():
            dup += line in seen
            seen.add(line)
            h = _line_hash(own)
            lines[h] = lines.get(h, 0) + len(own)
    chars = len(text) - sum(map(text.count, _SPACE))
    return len(words), chars, sum(map(data.count, _SYMBOLS)), dup, repeat_words(words), lines


def without_lines(text: str, drop: set[int]) -> str:
    """The text without the lines of these hashes."""
    lines = text.encode().split(b"\n")
    return b"\n".join(x for x in lines if not (own := x.lower().split()) or _line_hash(own) not in drop).decode()


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _host(source: Column) -> Column:
    """A null source is a host of its own, apart from any text."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source))


def measured(rows: DataFrame) -> DataFrame:
    """The statistics and line hashes of every row (uid, doc_id, text, source)."""
    schema = "uid long, doc_id string, host string, text_key long, " + ", ".join(f"{s} long" for s in _STATS) + ", lines array<struct<h: long, n: int>>"
    names = [c.split()[0] for c in schema.replace("array<struct<h: long, n: int>>", "array").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 512):
                out = []
                for uid, doc_id, host, text_key, text in zip(*(pdf[c].iloc[k : k + 512] for c in ("uid", "doc_id", "host", "text_key", "text")), strict=True):
                    *stats, lines = measure(text)
                    out.append((uid, doc_id, host, text_key, *stats, [{"h": h, "n": n} for h, n in lines.items()]))
                yield pd.DataFrame(out, columns=names)

    made = rows.select("uid", F.col("doc_id").cast("string").alias("doc_id"), _host(F.col("source")).alias("host"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    return made.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def _order() -> list[Column]:
    """The order of a host's documents; rows that repeat each other follow in any order, which no result shows."""
    return [F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"), F.col("uid")]


def _met(rows: DataFrame, lines: DataFrame, total: int) -> DataFrame:
    """rows.join(lines, ["host", "h"]), where `lines` (host, h, docs, ...) has a row for each.

    Lines that are common in the whole table are broadcast, fewer than
    1 / HOT_SHARE of them; no key of the join that is left has more than that
    share of the rows.
    """
    hot = F.col("docs") > total * HOT_SHARE
    marked = rows.join(F.broadcast(lines.filter(hot).withColumn("_hot", F.lit(True))), ["host", "h"], "left")
    rest = marked.filter("_hot IS NULL").select(*rows.columns).join(lines.filter(~hot), ["host", "h"])
    return marked.filter("_hot").drop("_hot").unionByName(rest)


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, left_words: int = LEFT_WORDS, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """Statistics and verdict of every row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words (and host).

    A null text has no words and fails. A null source is a host of its own.
    Each row is a document: rows with equal doc_id are counted and judged each
    by itself, and so are those that repeat each other wholly. A host's documents
    are ordered by doc_id, a null one last. Texts of any length are read whole.
    An empty table gives no rows; other columns take no part.
    """
    rows = need(docs, "doc_id", "text", "source").withColumn("uid", F.monotonically_increasing_id())
    return _judged(stage(measured(rows), "lines"), max_docs, max_share, left_words, left_percent)[0].drop("uid", "text_key")


def _above(every: DataFrame, found: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """(host, h, docs) of the lines above the limit."""
    # A document has a line once here, so rows count documents, and tasks combine before they shuffle.
    lines = stage(every.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > max_docs), "common")
    hosts = found.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    return stage(join_hot(lines, hosts, ["host"], hot_keys(lines, ["host"])).filter(F.col("docs") > max_share * F.col("host_docs")).select("host", "h", "docs"), "above")


def _judged(found: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, left_words: int = LEFT_WORDS, left_percent: int = LEFT_PERCENT) -> tuple[DataFrame, DataFrame]:
    """The verdict on measured(), and the lines that documents lose: uid, h, n."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))

    def depleted(removed: Column) -> Column:
        left = F.col("n_words") - removed
        return (removed > 0) & ((left < left_words) | (100 * left < left_percent * F.col("n_words")))

    every = found.select("uid", F.struct(*_order()).alias("at"), "host", "n_words", failed.alias("failed"), F.explode("lines").alias("line")).select("uid", "at", "host", "n_words", "failed", "line.h", "line.n")
    above = _above(every, found, max_docs, max_share)
    total = found.agg(F.sum(F.size("lines"))).first()[0] or 0
    # kept: null as long as it is undecided.
    rows, (open_,) = observed_stage(_met(every, above, total).withColumn("kept", F.when(F.col("failed"), False)).drop("docs", "failed"), "shared", F.count_if(F.col("kept").isNull()))
    while True:
        first = rows.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs"), F.min(F.when(F.col("kept"), F.col("at"))).alias("first_kept"), F.min(F.when(F.col("kept").isNull(), F.col("at"))).alias("first_open"))
        seen = _met(rows, first, total).drop("docs")
        taken = F.coalesce(F.col("first_kept") < F.col("at"), F.lit(False))
        if not open_:
            lost = stage(seen.filter(taken).select("uid", "h", "n"), "lost")
            break
        possible = taken | F.coalesce(F.col("first_open") < F.col("at"), F.lit(False))
        sums = seen.filter(F.col("kept").isNull()).groupBy("uid").agg(F.first("n_words").alias("n_words"), F.sum(F.when(taken, F.col("n")).otherwise(0)).alias("least"), F.sum(F.when(possible, F.col("n")).otherwise(0)).alias("most"))
        decided = sums.select("uid", F.when(depleted(F.col("least")), False).when(~depleted(F.col("most")), True).alias("now"))
        rows, (open_,) = observed_stage(rows.join(decided, "uid", "left").withColumn("kept", F.coalesce("kept", "now")).drop("now"), "shared", F.count_if(F.col("kept").isNull()))
    removed = lost.groupBy("uid").agg(F.sum("n").alias("n_removed_words"))
    base = found.drop("lines").join(removed, "uid", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    kept = ~failed & ~depleted(F.col("n_removed_words"))
    return base.select("doc_id", *_STATS, failed.alias("base_failed"), kept.alias("kept"), "n_removed_words", "host", "text_key", "uid"), lost


def filter_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows that judge() keeps, without the lines they lose; n_chars, if there, follows, other columns as they were.

    Nulls, repeated rows, ties, very long texts and empty tables: as in judge(). Columns may have any names.
    """
    rows = stage(packed(docs).withColumn("uid", F.monotonically_increasing_id()), "numbered")
    verdict, lost = _judged(stage(measured(rows.select("uid", "row.doc_id", "row.text", "row.source")), "lines"), **limits)
    drop = lost.groupBy("uid").agg(F.collect_set("h").alias("drop"))

    @F.pandas_udf("string")
    def cleaned(text: pd.Series, drop: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else without_lines(t, set(x.tolist())) for t, x in zip(text, drop, strict=True)], dtype=object)

    joined = rows.join(verdict.filter("kept").select("uid").join(drop, "uid", "left"), "uid")
    # Texts that stay whole don't go through Python.
    changed, text = F.col("drop").isNotNull(), F.col("row")["text"]
    joined = joined.withColumn("cleaned", cleaned(F.when(changed, text), F.col("drop")))
    new = {"text": F.when(changed, F.col("cleaned")).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("cleaned").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return unpacked(joined, docs.columns, new)
