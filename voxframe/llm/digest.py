"""Locality-sensitive document digests by bucket quartiles.

Byte triplets of the whole UTF-8 text are hashed into 256 buckets. Each bucket's
count is coded by the quartile of all counts that it falls in (two bits), and the
length by its logarithm. Texts that share most of their content get digests that
differ in few buckets, whatever was moved or replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, partitions, stage

BUCKETS = 256
#: A triplet's bytes lie so far apart: wider than most syllables, so that a text's own
#: word order counts and not only its language's frequent letter groups.
STEP = 5
_WINDOW = 2 * STEP
#: What two codes that lie 0, 1, 2 or 3 quartiles apart add to the difference.
APART = np.array([0, 1, 2, 6])
#: The most that lengths add to it: the difference is bounded by BUCKETS * 6 + LENGTH_MOST.
LENGTH_MOST = 64
_PIECE = 1 << 20


def fingerprint(data: bytes) -> str:
    """132 hexadecimal digits: the version, the length's logarithm and 256 quartile codes.

    Zero bytes are set before and after the data, so that each byte takes each
    place of a triplet and any text, the empty one too, has triplets.
    """
    framed = np.frombuffer(bytes(_WINDOW) + data + bytes(_WINDOW), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(framed) - _WINDOW, _PIECE):  # piece by piece: memory doesn't grow with the text
        b = framed[at : at + _PIECE + _WINDOW].astype(np.uint32)
        n = len(b) - _WINDOW
        h = (b[:n] | b[STEP : STEP + n] << np.uint32(8) | b[_WINDOW:] << np.uint32(16)) * np.uint32(0x9E3779B1)
        counts += np.bincount((h ^ h >> np.uint32(15)) >> np.uint32(16) & np.uint32(255), minlength=BUCKETS)
    ordered = np.sort(counts)
    codes = np.searchsorted(ordered[[63, 127, 191]], counts, "left").astype(np.uint8)
    codes = codes.reshape(-1, 4)
    packed = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return f"01{min(255, round(math.log1p(len(data)) * 12)):02x}{packed.tobytes().hex()}"


def _codes(digest: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(digest[4:]), np.uint8)
    return packed[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3


def difference(a: str, b: str) -> int:
    """0 for equal digests, BUCKETS * 6 + LENGTH_MOST at most."""
    apart = np.abs(_codes(a).astype(np.int8) - _codes(b).astype(np.int8))
    return int(APART[apart].sum()) + min(LENGTH_MOST, abs(int(a[2:4], 16) - int(b[2:4], 16)))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 at the greatest difference."""
    return 1.0 - difference(a, b) / (BUCKETS * int(APART[3]) + LENGTH_MOST)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_ROW = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, text: str, own: str, following: str, next_digest: str) -> tuple:
    data = edited(text, following).encode()
    other = fingerprint(data)
    return doc_id, len(text), hashlib.sha256(data).hexdigest(), own, other, likeness(own, other), likeness(own, next_digest)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next of every row, the next row being that with the next smaller doc_id
    and, after the last, the first.

    Rows with equal doc_id follow each other by text digest and text; null
    doc_ids come last. A null text counts as empty. A single row is its own
    next row; an empty table gives no rows.

    Rows are dealt out by ranges of doc_id and go through each task in order. The
    first and last texts of each task are set aside and joined afterwards, two
    rows for each partition.
    """
    spark = docs.sparkSession
    names = [*(c.split()[0] for c in _ROW.split(", ")), "part", "edge", "text"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before = TaskContext.get().partitionId(), None
        none = (None,) * 6
        for pdf in batches:
            for k in range(0, len(pdf), 512):
                rows = []
                for doc_id, text in zip(pdf["doc_id"].iloc[k : k + 512], pdf["text"].iloc[k : k + 512], strict=True):
                    now = doc_id, text, fingerprint(text.encode())
                    if before:
                        rows.append((*_row(*before, text, now[2]), part, None, None))
                    else:
                        rows.append((doc_id, *none, part, "first", text))
                    before = now
                if rows:
                    yield pd.DataFrame(rows, columns=names)
        if before:
            yield pd.DataFrame([(before[0], *none, part, "last", before[1])], columns=names)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                yield pd.DataFrame([_row(r.doc_id, r.text, fingerprint(r.text.encode()), r.following, fingerprint(r.following.encode()))], columns=names[:7])

    rows = need(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, "text")
    walked = stage(dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(walk, f"{_ROW}, part int, edge string, text string"), "digests")
    parts = [r["part"] for r in walked.filter("edge = 'first'").select("part").orderBy("part").collect()]
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    first = walked.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    last = walked.filter("edge = 'last'").select("doc_id", "text", "part")
    ends = last.join(following, "part").join(first, "next_part").select("doc_id", "text", "following").mapInPandas(join, _ROW)
    own = [c.split()[0] for c in _ROW.split(", ")]
    return walked.filter("edge IS NULL").select(*own).unionByName(ends).withColumn("doc_id", F.col("doc_id").cast("long"))
