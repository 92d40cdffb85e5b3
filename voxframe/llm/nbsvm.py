"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by Naive Bayes log-count ratios.

A text's features are the hashed n-grams that occur in it: one to three code
points (digits alike), words, pairs of words, and threes of marks that say whether
a word repeats the one before it. Each indicator is scaled by the log ratio of
its smoothed shares in the two classes, over the root of the number of features,
so that short texts weigh as long ones; the weights come from dual coordinate
descent on the hinge loss. A logistic curve, fitted on margins of rows that the
weights hadn't seen, turns margins into scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need

BITS = 18
DIM = 1 << BITS
#: The model is fitted on about this many labelled documents of each class, chosen by a hash of doc_id.
SAMPLE_PER_CLASS = 2000
COST, EPOCHS, TOLERANCE = 0.1, 40, 1e-3
#: From this score on a document counts as class 1.
THRESHOLD = 0.7
#: The logistic curve is fitted on margins by weights that were fitted without these parts of the sample in turn.
FOLDS = 3
_PIECE = 1 << 17
_ODD = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _places(h: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of one kind of n-gram, mixed and cut to BITS."""
    h = (h ^ np.uint32(kind * 0x51ED270B & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    return (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)


def _mark(c: np.ndarray, whole: bool, seen: np.ndarray) -> int:
    """Mark the features of one piece of code points; gives the start of its fourth word from the end.

    whole: the piece starts the text, so its first word repeats none.
    """
    digit = (c >= 48) & (c < 58)
    own = np.where(digit, np.uint32(48), c) * np.uint32(0x9E3779B1)
    own ^= own >> np.uint32(15)
    two = (own[:-1] * np.uint32(0x85EBCA77) ^ own[1:]) * np.uint32(0x27D4EB2F)
    seen[_places(own, 1)] = True
    seen[_places(two, 2)] = True
    seen[_places((two[:-1] * np.uint32(0x85EBCA77) ^ own[2:]) * np.uint32(0x27D4EB2F), 3)] = True
    inside = ~((c == 32) | ((c >= 9) & (c <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return len(c)
    at = np.flatnonzero(inside)
    of = np.cumsum(first[at]) - 1
    words = np.add.reduceat(own[at] * _ODD[(at - starts[of]) & 63], np.flatnonzero(first[at]), dtype=np.uint32)
    again = np.r_[False, words[1:] == words[:-1]].astype(np.uint32)
    seen[_places(words, 4)] = True
    seen[_places(words[:-1] * np.uint32(0xC2B2AE3D) ^ np.where(again[1:] > 0, np.uint32(1), words[1:] * np.uint32(0x165667B1)), 5)] = True
    threes = again[:-2] * np.uint32(4) + again[1:-1] * np.uint32(2) + again[2:]
    seen[_places(threes if whole else threes[1:], 6)] = True
    return int(starts[-4]) if len(starts) >= 4 else 0


class Indicators:
    """Features of texts, one after another, over one table of marks."""

    def __init__(self) -> None:
        self.seen = np.zeros(DIM, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted places of all features of the whole text; none for a null or empty one.

        Long texts go by in pieces that share their last words, so memory is
        bounded; a word of more than a piece (131,072 code points) is cut.
        """
        text = text or ""
        start = 0
        while start < len(text):
            part = text[start : start + _PIECE]
            last = start + len(part) >= len(text)
            if not last:
                cut = max(part.rfind(" "), part.rfind("\n"))
                part = part[:cut] if cut > _PIECE // 2 else part
            back = _mark(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4"), start == 0, self.seen)
            start = len(text) if last else start + (back if back > _PIECE // 4 else len(part) - 2)
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


@dataclass
class Model:
    weights: np.ndarray  # of each feature, scaled by its ratio
    bias: float
    slope: float
    shift: float

    def margin(self, places: np.ndarray) -> float:
        return float(self.weights[places].sum(dtype=np.float64)) / math.sqrt(max(1, len(places))) + self.bias

    def score(self, places: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(places) + self.shift, -500, 500))))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Of each feature, log of its smoothed share of the indicators of class 1, over that of class 0."""
    shares = []
    for k in (True, False):
        n = 1.0 + np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == k] or [np.empty(0, int)]), minlength=DIM)
        shares.append(np.log(n / n.sum()))
    return shares[0] - shares[1]


def descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights on the scaled indicators, over the root of their number, and bias: least 0.5 |w|^2 + cost * sum of hinge losses, by dual coordinate descent in a seeded order."""
    weights, bias, alpha, order = np.zeros(len(ratio)), 0.0, np.zeros(len(rows)), np.random.default_rng(0)
    length = np.array([math.sqrt(max(1, len(r))) for r in rows])
    square = np.array([((ratio[r] / n) ** 2).sum() + 1 for r, n in zip(rows, length, strict=True)])
    sign = np.where(labels, 1.0, -1.0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x = ratio[rows[i]] / length[i]
            slope = sign[i] * (weights[rows[i]] @ x + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            step = (new - alpha[i]) * sign[i]
            if step:
                weights[rows[i]] += step * x
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step) * square[i])
        if moved < TOLERANCE:
            break
    return weights, bias


def curve(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through weighted margins, by Newton steps on smoothed targets."""
    ones, zeros = weights[labels].sum(), weights[~labels].sum()
    target = np.where(labels, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        gradient = x.T @ (weights * (p - target)) + 1e-3 * (at - [1.0, 0.0])
        step = np.linalg.solve((x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        at = at - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return max(float(at[0]), 1e-3), float(at[1])


def fit(rows: list[np.ndarray], labels: list[bool], sizes: tuple[int, int]) -> Model:
    """From sampled rows in a fixed order; sizes: the documents of class 0 and 1 that they stand for.

    With rows of one class alone, or none, every text gets the same score: the share of class 1, 0.5 without any.
    """
    y = np.array(labels, bool)
    share = (sizes[1] + 1) / (sum(sizes) + 2)
    if y.all() or not y.any():
        return Model(np.zeros(DIM, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    part = np.empty(len(y), int)
    for k in (True, False):
        part[y == k] = np.arange((y == k).sum()) % FOLDS

    def weigh(own: np.ndarray) -> Model:
        chosen = [rows[i] for i in np.flatnonzero(own)]
        ratio = log_ratios(chosen, y[own])
        weights, bias = descend(chosen, y[own], ratio)
        return Model((weights * ratio).astype(np.float32), bias, 1.0, 0.0)

    model, margins = weigh(np.ones(len(y), bool)), np.empty(len(y))
    for k in range(FOLDS):
        apart = part == k
        judge = weigh(~apart) if len(set(y[~apart])) == 2 else model
        margins[apart] = [judge.margin(rows[i]) for i in np.flatnonzero(apart)]
    stands = np.where(y, sizes[1] / y.sum(), sizes[0] / (~y).sum())
    model.slope, model.shift = curve(margins, y, stands / stands.mean())
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on about `sample` documents of each class: labels (doc_id, label) of 0 or 1, met with docs (doc_id, text).

    Labels that repeat count once; an id with both labels is left out. Of several
    texts of an id the one with the least hash counts. The ids drawn, about twice
    `sample`, are broadcast, so no text but theirs is shuffled.
    """
    known = labels.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62))
    below = F.when(F.col("label") == 1, F.lit(int(min(1.0, sample / max(1, sizes.get(1, 0))) * (1 << 62)))).otherwise(int(min(1.0, sample / max(1, sizes.get(0, 0))) * (1 << 62)))
    drawn = known.filter(place <= below).select("doc_id", "label")
    met = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def indicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Indicators()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "places": [places(t if isinstance(t, str) else None).astype("<u4").tobytes() for t in pdf["text"]]})

    got = sorted(map(tuple, met.mapInPandas(indicate, "doc_id long, label int, places binary").collect()))
    return fit([np.frombuffer(p, "<u4").astype(np.int64) for _, _, p in got], [y == 1 for _, y, _ in got], (sizes.get(0, 0), sizes.get(1, 0)))


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` and score of every row, from its whole text alone."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double"])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM floats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Indicators()
        for pdf in batches:
            yield pdf[list(keep)].assign(score=[sent.value.score(places(t if isinstance(t, str) else None)) for t in pdf["text"]])

    return docs.select(*keep, "text").mapInPandas(run, schema)


def held_out_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs, learned from `labels.quality` of those not held out.

    held_out: crc32 of doc_id as text leaves 2 when divided by 4; a null doc_id is
    not held out and has no label. Null and empty texts have no features and get
    the score of the bias; very long ones are read whole. Rows that share an id
    or repeat each other are scored each by itself. Labels other than 0 and 1
    count as none; without labels all scores are 0.5. An empty table gives no
    rows; other columns take no part.
    """
    rows, known = need(docs, "doc_id", "text"), need(labels, "doc_id", "quality")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    usable = F.col("quality").isin(0, 1)
    model = train(rows, known.filter(~out & usable).select("doc_id", F.col("quality").cast("int").alias("label")), sample)
    as_text = rows.select(F.col("doc_id").cast("string").alias("doc_id"), out.alias("held_out"), "text")
    found = scored(as_text, model, ("doc_id", "held_out"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
