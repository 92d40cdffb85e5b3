"""Best-fit-decreasing packing of token pieces into sequences of fixed length.

Best fit decreasing depends on lengths only, and there are at most `capacity` of
them, so the plan is made from the histogram of lengths: a segment tree over
remaining capacities finds the tightest open bin, and equal pieces that go to
equal bins are placed in one step. The plan is a table of steps (length, ranks
among the pieces of that length, sequence, offset), and each piece meets its step
by a join on its length and block of ranks. No task ever holds all pieces, and
the result is what a plain best fit decreasing over all of them would give.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter, deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, stage
from .encode import encoder


class TightestFit:
    """A segment tree over remaining capacities 0..capacity that tells which have open bins."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.leaves)

    def mark(self, room: int, is_open: bool) -> None:
        i = room + self.leaves
        self.open[i] = is_open
        while i > 1:
            i //= 2
            now = self.open[2 * i] | self.open[2 * i + 1]
            if self.open[i] == now:
                return
            self.open[i] = now

    def find(self, length: int) -> int | None:
        """The least remaining capacity of at least `length` that has an open bin."""
        i = length + self.leaves
        if self.open[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


#: Ranks of a length that are joined with their steps by one key.
RANKS = 512


def plan(histogram: dict[int, int], capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Steps (length, first rank, ranks, first sequence, offset): pieces of that length
    from that rank on go to consecutive sequences at that offset.

    A remaining capacity is left at most once for each length, so there are at
    most capacity**2 / 2 steps however many pieces there are.
    """
    tree, rooms, made = TightestFit(capacity), {}, 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.find(length)
            if room is None:  # new bins, each as full of this length as it gets
                each = capacity // length
                whole, rest = divmod(left, each)
                for bins, fill in ((whole, each), (1, rest)):
                    if not bins or not fill:
                        continue
                    for k in range(fill):
                        yield length, rank, bins, made, k * length
                        rank += bins
                    _put(tree, rooms, capacity - fill * length, made, bins)
                    made += bins
                break
            bins = rooms[room]
            first, count = bins.popleft()
            take = min(count, left)
            if take < count:
                bins.appendleft((first + take, count - take))
            elif not bins:
                tree.mark(room, False)
            yield length, rank, take, first, capacity - room
            rank, left = rank + take, left - take
            _put(tree, rooms, room - length, first, take)


def _put(tree: TightestFit, rooms: dict[int, deque], room: int, first: int, count: int) -> None:
    if not room:
        return
    bins = rooms.setdefault(room, deque())
    if not bins:
        tree.mark(room, True)
    elif sum(bins[-1]) == first:
        first, count = bins[-1][0], bins.pop()[1] + count
    bins.append((first, count))


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, with the task that made
    it and its rank among that task's pieces of the same length."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, end, seen = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), Counter()
        task = TaskContext.get().partitionId()
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                part, rows = pdf.iloc[k : k + 256], []
                for doc_id, ids in zip(part["doc_id"], codec.encode(part["text"].tolist()), strict=True):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        length = len(own) // 4
                        rows.append((doc_id, n, at // 4, length, zlib.crc32(own), task, seen[length]))
                        seen[length] += 1
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])
                out["doc_id"] = out["doc_id"].astype("string")
                yield out

    rows = need(docs, "doc_id", "text").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = rows.mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long, task int, rank long")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def planned(lengths: DataFrame, capacity: int) -> DataFrame:
    """The steps (length, at, ranks, first, offset) for a table (length, n) of at most `capacity` rows, made by one task as they come."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        histogram: dict[int, int] = {}
        for pdf in batches:
            histogram |= dict(zip(pdf["length"].tolist(), pdf["n"].tolist(), strict=True))
        steps = plan(histogram, capacity)
        while some := array("q", [x for step in islice(steps, 50_000) for x in step]):
            yield pd.DataFrame(np.frombuffer(some, "i8").reshape(-1, 5), columns=["length", "at", "ranks", "first", "offset"])

    return lengths.coalesce(1).mapInPandas(run, "length long, at long, ranks long, first long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A null text counts as empty and is one piece, the end id. A text of any
    length is encoded whole and cut into pieces of `capacity`. Rows with the same
    doc_id are packed each by itself; null doc_ids stay null. An empty table
    gives no rows; other columns take no part.
    """
    made = stage(pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    counts = stage(made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    steps = stage(planned(counts.groupBy("length").agg(F.sum("n").alias("n")), capacity), "steps")
    # Counts and steps grow with the documents up to their bounds, so they aren't broadcast while they happen to be few.
    before = counts.selectExpr("length", "task", "sum(n) OVER (PARTITION BY length ORDER BY task) - n AS before")
    ranked = made.join(before.hint("merge"), ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.withColumn("block", F.expr(f"rank div {RANKS}"))
    blocks = steps.withColumn("block", F.explode(F.sequence(F.expr(f"at div {RANKS}"), F.expr(f"(at + ranks - 1) div {RANKS}"))))
    placed = ranked.join(blocks.hint("merge"), ["length", "block"]).filter("rank >= at AND rank < at + ranks")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("at")).alias("sequence_id"), "offset")
