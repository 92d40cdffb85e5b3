"""Hard negatives by inner product, found exactly with k-means inverted lists.

Rows with equal label and vector are one class, of which no more members are kept
than a result can show; so a vector that a third of all rows share is scored
once. Classes lie in the list of their nearest centroid, in blocks of bounded
size, and each list stores its radius. By Cauchy and Schwarz an anchor's score
with a member is within |anchor| * radius of its score with the centroid. An
anchor visits lists by falling upper bound, a few at first and STEP times as many
each round, skips those that lie outside its window, and stops when the bound
falls strictly below the score of the last row that it would return.

Visits are one row for each anchor in a round, with the numbers of the blocks that
it asks, never a row with its vector for each list. Blocks stand on shelves; an
anchor goes to a shelf once, and a task has one shelf and ASKS anchors at a time.
What a task holds doesn't grow with rows or anchors, but for the numbers of the
blocks that AT_ONCE anchors ask.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, need, observed_stage, partitions, stage

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of its positive's.
LEAST, MOST = 30, 90
SCALE = 256
#: Centroids are fitted on about this many classes, chosen by hash; every class is put into a list.
SAMPLE = 20_000
#: As many lists as the root of the number of classes, but no more than this: centroids go to every task.
MAX_LISTS = 4096
#: Classes of a block, and anchors that meet a shelf of blocks at once.
BLOCK, ASKS = 2048, 4096
#: Classes of a shelf, by the number of tasks.
SMALL_SHELF, LARGE_SHELF = 512, 8192
#: Anchors that are planned or scored in one step, rows that are placed in one, and candidates that a task holds before it cuts them.
AT_ONCE, PLACED, HELD = 256, 1024, 1 << 19
#: Lists that an anchor visits in its first round, and by how much more in each next one.
STEP = 8
_LONG = (1 << 63) - 1
#: The kth score of a window that isn't full yet.
LOWEST = -_LONG - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices: in floats or doubles where none can be rounded, else in Python's integers, cut to longs."""
    most = max(1, abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))) * max(1, abs(int(b.max(initial=0))), abs(int(b.min(initial=0)))) * max(1, a.shape[1])
    if most < 1 << 53:
        kind = np.float32 if most < 1 << 24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LOWEST, _LONG).astype(np.int64)


def _narrow(m: np.ndarray) -> np.ndarray:
    return next(m.astype(t) for t in ("<i2", "<i4", "<i8") if not m.size or (m.min() >= np.iinfo(t).min and m.max() <= np.iinfo(t).max))


class Lists:
    """What every task knows of the index: MAX_LISTS centroids, radii and numbers of blocks at most, and the shelf of each block, which never falls from a block to the next."""

    def __init__(self, centres: np.ndarray, radius: np.ndarray, parts: np.ndarray, shelves: np.ndarray | None = None):
        self.centres, self.radius, self.parts = centres, radius, parts
        self.stops = np.cumsum(parts)
        self.shelves = np.zeros(int(self.stops[-1]), int) if shelves is None else shelves

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that a member of each list can have, rounding allowed for."""
        middle, length = self.centres @ a, float(np.linalg.norm(a))
        reach = length * self.radius
        slack = 1e-9 * (length * np.linalg.norm(self.centres, axis=1) + reach) + 1e-6
        return middle - reach - slack, middle + reach + slack

    def visits(self, a: np.ndarray, positives: list[int], kth: list[float], start: int, most: int) -> tuple[list[int], int]:
        """The next lists to visit from a place in the anchor's order, and the place after them.

        positives: the windows' positive scores; none: one window without limits.
        kth: the score below which each window takes no more rows. A list is
        visited if for some window it can hold a row inside it that isn't strictly
        below.
        """
        low, high = self.bounds(a)
        best, wanted = np.full(len(low), -np.inf), np.zeros(len(low), bool)
        for p, k in zip(positives or [None], kth, strict=True):
            # A list that can reach beyond the window's top counts as the top.
            top = high if p is None else np.minimum(high, MOST * p / 100)
            inside = self.parts > 0
            if p is not None:
                inside &= (high >= LEAST * p / 100) & (low <= MOST * p / 100)
            best = np.where(inside, np.maximum(best, top), best)
            wanted |= inside & (top >= k)
        order = np.argsort(-best, kind="stable")
        places = np.flatnonzero(wanted[order[start:]])[:most] + start
        return order[places].tolist(), int(places[-1]) + 1 if len(places) else len(order)

    def shelved(self, found: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The shelves on which blocks of these lists stand, and the blocks on each."""
        lists = np.sort(found)
        n = self.parts[lists]
        own = np.repeat(self.stops[lists] - np.cumsum(n), n) + np.arange(n.sum())
        cuts = np.flatnonzero(np.diff(self.shelves[own])) + 1
        return self.shelves[own[np.r_[0, cuts]]], np.split(own, cuts)


def _usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, x of the rows that take part; shorter vectors are filled up with zeros."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE))
    return rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", label.alias("label"), x.alias("x"))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if dim else np.zeros((len(column), 0), np.int64)


def _index(classes: DataFrame, dim: int) -> tuple[DataFrame, Lists]:
    """Blocks of all classes (block, shelf, and packed members), and what every task knows of them."""
    total = classes.count()
    share = min(1.0, SAMPLE / total)
    drawn = classes.filter(F.pmod(F.xxhash64("label", "x"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("x")
    lists = max(1, min(math.isqrt(total), MAX_LISTS))
    if lists == 1 or dim == 0:
        centres = np.zeros((1, dim))
    else:
        points = drawn.select(array_to_vector(F.col("x").cast("array<double>")).alias("features"))
        centres = np.array(KMeans(k=lists, seed=12, maxIter=8, initSteps=1).fit(points).clusterCenters())
    sent = classes.sparkSession.sparkContext.broadcast(centres)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        square = (c**2).sum(axis=1)
        for pdf in batches:
            for k in range(0, len(pdf), PLACED):
                part = pdf.iloc[k : k + PLACED]
                own = _matrix(part["x"], dim).astype(np.float64)
                at = (square - 2 * own @ c.T).argmin(axis=1)
                yield part.assign(cluster=at.astype(np.int32), distance=np.linalg.norm(own - c[at], axis=1))

    placed = stage(classes.mapInPandas(near, "label long, x array<long>, ids array<long>, nones array<boolean>, uids array<long>, cluster int, distance double"), "placed")
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()  # MAX_LISTS rows at most
    radius, parts, own = np.zeros(len(centres)), np.zeros(len(centres), int), np.zeros(len(centres))
    for r in sizes:
        radius[r["cluster"]], parts[r["cluster"]], own[r["cluster"]] = r["radius"], -(-r["n"] // BLOCK), r["n"]
    # LARGE_SHELF classes on a shelf, or fewer where that would leave tasks without one; an anchor's row goes to each shelf.
    each = np.repeat(own / np.maximum(parts, 1), parts)
    shelf = min(LARGE_SHELF, max(SMALL_SHELF, total // partitions(classes.sparkSession)))
    shelves = ((np.cumsum(each) - each) // shelf).astype(int)
    lists = Lists(centres, radius, parts, shelves)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # In the order of their first rows, so that of classes with equal scores the one that comes first is known by its place.
        pdf = pdf.iloc[np.lexsort([pdf[c].map(lambda v: v[0]).to_numpy() for c in ("uids", "ids", "nones")])]
        block = int(lists.stops[key[0]] - lists.parts[key[0]]) + key[1]
        x = _narrow(_matrix(pdf["x"], dim))
        stops = np.cumsum(pdf["ids"].map(len).to_numpy(), dtype="<i8")
        flat = [np.concatenate(pdf[c].to_numpy()).astype(t).tobytes() for c, t in (("ids", "<i8"), ("nones", "?"), ("uids", "<i8"))]
        return pd.DataFrame([(block, shelves[block], x.dtype.str, x.tobytes(), pdf["label"].to_numpy("<i8").tobytes(), stops.tobytes(), *flat)], columns=["block", "shelf", "kind", "x", "labels", "stops", "ids", "nones", "uids"])

    part = F.pmod(F.xxhash64("label", "x"), F.element_at(F.array(*[F.lit(int(max(1, p))) for p in parts]), F.col("cluster") + 1)).cast("int")
    blocks = placed.withColumn("part", part).groupBy("cluster", "part").applyInPandas(pack, "block int, shelf int, kind string, x binary, labels binary, stops binary, ids binary, nones binary, uids binary")
    return stage(blocks, "blocks"), lists


def _plans(known: Lists, batches: Iterator[pd.DataFrame], take: int) -> Iterator[pd.DataFrame]:
    """Each query that has lists left to visit, with the shelves it asks and the blocks of each; AT_ONCE queries at a time."""
    for pdf in batches:
        for k in range(0, len(pdf), AT_ONCE):
            out = []
            for r in pdf.iloc[k : k + AT_ONCE].itertuples(index=False):
                kth = [-math.inf if k == LOWEST else k for k in r.kth.tolist()]  # bounds aren't cut to longs
                found, after = known.visits(np.asarray(r.x, np.float64), r.positives.tolist(), kth, int(r.start), take)
                if found:
                    out.append((r.qid, r.label, r.x, r.positives, r.kth, after, *known.shelved(found)))
            if out:
                yield pd.DataFrame(out, columns=["qid", "label", "x", "positives", "kth", "start", "shelves", "asked"])


def _first(row: np.ndarray, most: int, *keys: np.ndarray) -> np.ndarray:
    """Places of the first `most` entries of each row by the keys, of which the last counts most; equal ones stay in order."""
    order = np.lexsort((*keys, row))
    row = row[order]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
    return order[place < most]


def _score(asked: pd.DataFrame, blocks: pd.DataFrame, dim: int, most: int, same: bool) -> pd.DataFrame:
    """The first `most` rows in each window of the queries among the blocks of a shelf that they ask. Ties go to the smaller vec_id, a null one last."""
    x, label = _matrix(asked["x"], dim), asked["label"].to_numpy()
    wide = max(map(len, asked["kth"]), default=1)
    # A window takes scores from low to high: LEAST * positive <= 100 * score <= MOST * positive, and none below kth.
    low, high = np.full((len(asked), wide), _LONG), np.full((len(asked), wide), LOWEST)
    for i, (positives, kth) in enumerate(zip(asked["positives"], asked["kth"], strict=True)):
        low[i, : len(kth)], high[i, : len(kth)] = kth, _LONG
        for j, p in enumerate(positives.tolist()):
            low[i, j], high[i, j] = max(low[i, j], -(-LEAST * p // 100)), MOST * p // 100
    least = low.min(axis=1, initial=_LONG)
    own = np.concatenate([np.zeros(0, int), *asked["asked"]])
    at = np.repeat(np.arange(len(asked)), asked["asked"].map(len).to_numpy(int))

    def cut(held: list[tuple]) -> tuple:
        row, score, nones, ids, uids = held = [np.concatenate(c) for c in zip(*held, strict=True)]
        keep = _first(row, most, uids, ids, nones, ~score)
        return tuple(c[keep] for c in held)

    held, rows = [tuple(np.zeros(0, t) for t in (int, int, bool, int, int))], 0
    for b in blocks.itertuples(index=False):
        labels, stops, ids, nones, uids = (np.frombuffer(v, t) for v, t in ((b.labels, "<i8"), (b.stops, "<i8"), (b.ids, "<i8"), (b.nones, "?"), (b.uids, "<i8")))
        members, vectors = np.diff(np.r_[0, stops]), np.frombuffer(b.x, b.kind).reshape(len(labels), dim)
        asking = at[own == b.block]
        for k in range(0, len(asking), AT_ONCE):
            q = asking[k : k + AT_ONCE]
            scores = inner(x[q], vectors)
            of, c = np.nonzero((scores >= least[q, None]) & ((labels == label[q, None]) == same))
            score, of = scores[of, c], q[of]
            for j in range(wide):
                fit = np.flatnonzero((score >= low[of, j]) & (score <= high[of, j]))
                fit = fit[_first(of[fit], most, ~score[fit])]
                n = members[c[fit]]
                row = np.repeat(stops[c[fit]] - np.cumsum(n), n) + np.arange(n.sum())
                held.append((np.repeat(of[fit] * wide + j, n), np.repeat(score[fit], n), nones[row], ids[row], uids[row]))
                rows += len(row)
            if rows > HELD:
                held, rows = [cut(held)], 0
    row, score, nones, ids, uids = cut(held)
    return pd.DataFrame({"qid": asked["qid"].to_numpy()[row // wide], "j": (row % wide).astype(np.int32), "score": score, "vec_id": ids, "none": nones, "uid": uids})


def _search(queries: DataFrame, blocks: DataFrame, lists: Lists, dim: int, most: int, same: bool) -> DataFrame:
    """(qid, j, score, vec_id, none, uid, place): the first `most` rows in each window of the queries (qid, label, x, positives).

    same: rows of the query's label, in one window without limits; else those of other labels in a window for each of `positives`.
    """
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast(lists)
    visit = "qid long, label long, x array<long>, positives array<long>, kth array<long>, start int, shelves array<int>, asked array<array<int>>"
    found_schema = "qid long, j int, score long, vec_id long, none boolean, uid long"
    first = Window.partitionBy("qid", "j").orderBy(F.desc("score"), "none", "vec_id", "uid")
    best = spark.createDataFrame([], found_schema)
    count, lowest = F.lit(1) if same else F.size("positives"), F.lit(LOWEST)
    state = queries.select("qid", "label", "x", "positives", F.array_repeat(lowest, count).alias("kth"), F.lit(0).alias("start"))
    total, take = queries.count(), STEP
    tasks, dealt = min(partitions(spark), -(-total // AT_ONCE)), max(1, -(-total // ASKS))
    while True:
        visits, (n,) = observed_stage(state.repartition(max(1, tasks), "qid").mapInPandas(lambda b, take=take: _plans(sent.value, b, take), visit), "visits", F.count(F.lit(1)))
        if not n:
            return best.withColumn("place", F.row_number().over(first))
        asks = visits.select("qid", "label", "x", "positives", "kth", F.pmod(F.xxhash64("qid"), F.lit(dealt)).cast("int").alias("deal"), F.explode(F.arrays_zip("shelves", "asked")).alias("at"))
        asks = asks.select("qid", "label", "x", "positives", "kth", "deal", F.col("at.shelves").alias("shelf"), F.col("at.asked").alias("asked"))
        wanted = asks.select(F.col("deal").alias("to"), F.explode("asked").alias("block")).distinct()
        met = asks.groupBy("shelf", "deal").cogroup(blocks.join(wanted, "block").groupBy("shelf", "to")).applyInPandas(lambda a, b: _score(a, b, dim, most, same), found_schema)
        # Spark cuts each task's rows to `most` of a window before it shuffles them.
        best = stage(best.unionByName(met).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most).drop("place"), "best")
        full = best.groupBy("qid", "j").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == most)
        full = full.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("j", "least"))).alias("full"))
        kth = F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.coalesce(F.try_element_at("full", j), lowest))
        state = visits.join(full, "qid", "left").select("qid", "label", "x", "positives", kth.alias("kth"), "start")
        take *= STEP


def mine(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: see RESULT.

    Rows with a null label, a null vector, or a null or non-finite component take
    no part. Where vec_id is divisible by 7 the label becomes (label + 1) % 10.
    Components become floor(256 * x), cut to longs, as scores are. Anchors are the
    rows whose vec_id is divisible by 100; each has its first 5 other rows of its
    label as positives, and for each of these the first 10 rows of other labels in
    the window are returned. Ties go to the smaller vec_id; a null one comes last,
    and such a row is no anchor. Rows that share an id, or repeat each other, are
    rows of their own. Vectors of unequal length meet as if filled up with zeros;
    of length 0, all scores are 0. An anchor without positives or negatives has no
    rows, an empty table gives none, and other columns take no part.
    """
    spark = vectors.sparkSession
    rows, (total, dim) = observed_stage(_usable(need(vectors, "vec_id", "embedding", "label")).withColumn("uid", F.monotonically_increasing_id()), "vectors", F.count(F.lit(1)), F.max(F.size("x")))
    if not total:
        return spark.createDataFrame([], RESULT)
    dim = int(dim)
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x"))))
    # No result shows more than NEGATIVES rows of a class, or POSITIVES besides the anchor.
    order = Window.partitionBy("label", "x").orderBy(F.col("vec_id").asc_nulls_last(), "uid")
    few = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(NEGATIVES, POSITIVES + 1))
    member = F.struct("place", F.coalesce("vec_id", F.lit(_LONG)).alias("id"), F.col("vec_id").isNull().alias("none"), "uid")
    classes = few.groupBy("label", "x").agg(F.sort_array(F.collect_list(member)).alias("m"))
    classes = stage(classes.select("label", "x", F.col("m.id").alias("ids"), F.col("m.none").alias("nones"), F.col("m.uid").alias("uids")), "classes")
    blocks, lists = _index(classes, dim)

    anchors = stage(rows.filter(F.col("vec_id") % 100 == 0), "anchors")
    queries = stage(anchors.select("label", "x").distinct().withColumn("qid", F.monotonically_increasing_id()), "queries")
    near = stage(_search(queries.withColumn("positives", F.array().cast("array<long>")), blocks, lists, dim, POSITIVES + 1, True), "near")
    asked = near.groupBy("qid").agg(F.array_sort(F.collect_set("score")).alias("positives"))
    asked = stage(queries.join(asked, "qid"), "asked")
    far = _search(asked, blocks, lists, dim, NEGATIVES, False)

    # One row for each distinct anchor: its nearest rows of the same label, and the negatives in each window.
    negatives = far.groupBy("qid", "j").agg(F.collect_list(F.struct(F.col("place").alias("rank"), F.when(~F.col("none"), F.col("vec_id")).alias("id"), "score")).alias("found"))
    windows = negatives.groupBy("qid").agg(F.collect_list(F.struct("j", "found")).alias("windows"))
    positives = near.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", F.when(~F.col("none"), F.col("vec_id")).alias("id"), "uid", "score"))).alias("near"))
    results = asked.join(positives, "qid").join(windows, "qid").select("label", "x", "positives", "near", "windows")
    met = join_hot(anchors, stage(results, "results"), ["label", "x"], hot_keys(anchors, ["label", "x"]))
    own = met.withColumn("near", F.slice(F.filter("near", lambda p: p["uid"] != F.col("uid")), 1, POSITIVES))
    each = own.select(F.col("vec_id").alias("anchor_id"), F.explode("near").alias("p"), "positives", "windows")
    found = F.filter("windows", lambda w: F.element_at("positives", w["j"] + 1) == F.col("p.score"))
    each = each.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.explode(F.flatten(F.transform(found, lambda w: w["found"]))).alias("n"))
    return each.select("anchor_id", "positive_id", F.col("n.rank").cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))
