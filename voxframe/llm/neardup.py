"""Near-duplicate detection by MinHash with one-permutation hashing.

A document's words give a set of hashed shingles. One permutation of the hash
space is cut into BINS bins; the least shingle of each bin is the bin's value,
and an empty bin takes the value of another one by optimal densification (each
bin tries bins of a random sequence of its own until it meets a filled one).
Bins in bands of ROWS give the buckets. In a bucket, candidate edges run from one
centre to the others, so their number is bounded by the bucket's size; every
edge is confirmed on the full sets.

Documents with equal sets form one class, and only classes are compared. A round
of stars compares the centre of each bucket with all others in it; classes that
became connected need no further comparison, and the next round takes another
centre among what is still apart. When stars no longer halve the pairs that are
left, these are compared by sketches, each in one bucket only, dealt over small
blocks of the bucket, so no task holds a whole bucket; those that pass are
confirmed. So no link hangs on the choice of centres, and no bucket is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, hot_keys, join_hot, need, observed_stage, packed, stage, unpacked

#: A pair at the threshold shares a given band with chance 0.8**6; that it shares none of 40 has chance 5e-6.
#: A pair at 0.5 shares one with chance 0.47, one at 0.3 with chance 0.03.
ROWS, BANDS = 6, 40
BINS = ROWS * BANDS
#: Bins of the sketches that compare pairs before their full sets are.
SKETCH = 512
#: The pairs left are dealt out when there are at most so many for each member of a bucket, or stars no longer halve them.
FEW_PAIRS = 4
#: Members of a block of a bucket whose pairs are dealt out.
BLOCK = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


#: The least hash of each bin.
_EDGES = np.array([-(-(k << 64) // BINS) for k in range(BINS)], np.uint64)


class _Words(dict):
    """A word's hash, remembered for the worker's next texts."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 400_000:
            self[word] = h
        return h


_words = _Words()


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted set of 64-bit hashes of the text's shingles of `size` words, A-Z lower-cased.

    Fewer words make one shingle, no words none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    s = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        s = s * _ODD + h[k : len(h) - size + 1 + k]
    return np.unique(_mix(s + np.uint64(size)))


@lru_cache(maxsize=1)
def _tries() -> np.ndarray:
    """Of each bin (column), the bins that it tries in turn if it is empty."""
    n = np.arange(4096 * BINS, dtype=np.uint64)
    return (_mix(n + _ODD) % np.uint64(BINS)).astype(np.int64).reshape(4096, BINS)


def signature(s: np.ndarray) -> np.ndarray:
    """The values of the bins of a sorted, non-empty set, densified."""
    at = np.searchsorted(s, _EDGES)
    filled = np.diff(np.r_[at, len(s)]) > 0
    values = s[np.minimum(at, len(s) - 1)]
    empty, k = np.flatnonzero(~filled), 0
    source = np.arange(BINS)
    while len(empty) and k < 4096:
        tried = _tries()[k : k + 64, empty]
        good = filled[tried]
        first = good.argmax(axis=0)
        found = good[first, np.arange(len(empty))]
        source[empty[found]] = tried[first[found], np.flatnonzero(found)]
        empty, k = empty[~found], k + 64
    source[empty] = np.flatnonzero(filled)[0]  # a chance of 1e-14
    return values[source]


def bands(values: np.ndarray) -> np.ndarray:
    rows, keys = values.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = _mix(keys * _ODD + rows[:, k])
    return keys.view(np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Of SKETCH bins, in three planes of SKETCH / 64 integers: whether the bin is filled, and two bits of its least shingle.

    Empty bins stay empty here: each filled bin samples one element of the union
    without replacement, so for small sets the share of equal bins is nearly the
    similarity itself.
    """
    at = np.searchsorted(s, np.arange(SKETCH, dtype=np.uint64) << np.uint64(64 - SKETCH.bit_length() + 1))
    filled = np.diff(np.r_[at, len(s)]) > 0
    codes = _mix(s[np.minimum(at, len(s) - 1)])
    planes = np.array([filled, filled & (codes & np.uint64(1) > 0), filled & (codes & np.uint64(2) > 0)])
    return np.packbits(planes, axis=1, bitorder="little").view(np.int64).ravel()


def _signed(documents: DataFrame, size: int) -> DataFrame:
    """uid, doc_id, text_key, n, set_a, set_b (a digest of the set), sketch and bands of every row."""
    schema = "uid long, doc_id string, text_key long, n long, set_a long, set_b long, sketch array<long>, bands array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uid = TaskContext.get().partitionId() << 33
        for pdf in batches:
            for k in range(0, len(pdf), 1024):
                rows = []
                for doc_id, text_key, text in zip(*(pdf[c].iloc[k : k + 1024] for c in ("doc_id", "text_key", "text")), strict=True):
                    s = shingles(text, size)
                    if len(s):
                        v = signature(s)
                        digest = (_mix(s ^ _ODD).sum(dtype=np.uint64), np.bitwise_xor.reduce(_mix(s + _ODD)))
                        rows.append((uid, doc_id, text_key, len(s), *np.array(digest, np.uint64).view(np.int64).tolist(), sketch(s), bands(v)))
                    else:
                        rows.append((uid, doc_id, text_key, 0, 0, 0, None, None))
                    uid += 1
                yield pd.DataFrame(rows, columns=["uid", "doc_id", "text_key", "n", "set_a", "set_b", "sketch", "bands"])

    made = need(documents, "doc_id", "text").select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    return made.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches allow the similarity: sizes exactly, sketches up to five standard
    deviations (and 0.01) of the estimate at the threshold.

    Of the bins filled on either side, a share equal to the similarity has one
    element on both; of the others that are filled on both sides a quarter agree
    by chance.
    """
    held, both, agree, words = F.lit(0), F.lit(0), F.lit(0), SKETCH // 64
    for k in range(words):
        (f, v, w), (g, x, y) = ([F.get(f"{side}.sketch", F.lit(k + plane * words)) for plane in range(3)] for side in (a, b))
        held, both = held + F.bit_count(f.bitwiseOR(g)), both + F.bit_count(f.bitwiseAND(g))
        agree = agree + F.bit_count(f.bitwiseAND(g).bitwiseAND(F.bitwise_not(v.bitwiseXOR(x).bitwiseOR(w.bitwiseXOR(y)))))
    t = percent / 100
    union = (F.col(f"{a}.n") + F.col(f"{b}.n")) / (1 + t)
    variance = t * (1 - t) / held * F.greatest(F.lit(0.02), 1 - held / union) + F.greatest(F.lit(0.0), both - t * held) / (3 * held * held)
    sizes = 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")
    return sizes & ((4 * agree - both) / 3 >= held * (t - 0.01 - 5 * F.sqrt(variance)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for the nodes of the edges (a, b).

    Alternating large and small stars (Kiveris et al. 2014), each round staged,
    until the edges are stars.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = large.union(least.filter("a <> m").select("a", F.col("m").alias("b"))).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(down.select("a", F.col("m").alias("b"))).distinct()
        edges, now = observed_stage(small, "edges", F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now


def _sets(documents: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, set): the full sets of the nodes (node, doc_id, text_key)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                part = pdf.iloc[k : k + 256]
                yield pd.DataFrame({"node": part["node"], "set": [shingles(t, size).tobytes() for t in part["text"]]})

    texts = need(documents, "doc_id", "text").withColumn("text_key", F.xxhash64("text")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_key") == F.col("w.text_key"))
    found = texts.join(nodes.alias("w"), same).select("node", F.coalesce("text", F.lit("")).alias("text"))
    # Repeated rows give a node's text more than once; a node's sets are equal, so any will do.
    return found.mapInPandas(run, "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, hot: list[int]) -> DataFrame:
    """The pairs (a, b, la, lb) whose sets are similar enough: 100 * intersection >= percent * union."""

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out)

    a, b = (sets.select(F.col("node").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
    return join_hot(pairs, a, ["a"], hot).join(b, "b").filter(similar("set_a", "set_b")).select("a", "b", "la", "lb")


def _star_links(members: DataFrame, hot: list[int], info: DataFrame, sets: DataFrame, turn: int, percent: int) -> DataFrame:
    """Of the pairs (a, b, la, lb) of each bucket's centre and another member those that are similar enough.

    The order of centres is the same in all buckets, so that classes which share
    many buckets mostly share their centre too and give one pair.
    """
    first = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "label")).alias("c"))
    centres = first.select("key", F.col("c.node").alias("a"), F.col("c.label").alias("la"))
    pairs = join_hot(members, centres, ["key"], hot).filter("label <> la").select("a", F.col("node").alias("b"), "la", F.col("label").alias("lb")).distinct()
    pairs = stage(pairs, "stars")
    hot = hot_keys(pairs, ["a"])
    l, r = (info.select(F.col("node").alias(k), F.struct("n", "sketch").alias(side)) for k, side in (("a", "l"), ("b", "r")))
    alike = join_hot(pairs, l, ["a"], hot).join(r, "b").filter(_alike("l", "r", percent)).select("a", "b", "la", "lb")
    return _confirmed(alike, sets, percent, hot)


def _left_links(members: DataFrame, hot: list[int], buckets: DataFrame, info: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of all pairs (a, b, la, lb) of unlike labels in a bucket those that are similar enough, each in the bucket of the first band that it shares.

    A bucket's members fall into blocks of about BLOCK, and each two blocks, and
    each block with itself, meet under a key of their own.
    """
    sized = join_hot(members, buckets.select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), ["key"], hot)
    sized = sized.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    full = stage(sized.join(info.select("node", F.struct("n", "sketch", "bands").alias("seen")), "node"), "left")
    x = full.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", F.col("blocks") - 1))).alias("x")
    y = full.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own")))).alias("y")
    cell = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    once = (F.col("x.i") < F.col("x.j")) | (F.col("x.node") < F.col("y.node"))
    same = F.zip_with("x.seen.bands", "y.seen.bands", lambda p, q: p == q)
    here = F.array_position(same, F.lit(True)) == F.col("x.band") + 1
    found = x.join(y, cell & once & (F.col("x.label") != F.col("y.label")) & _alike("x.seen", "y.seen", percent) & here)
    found = stage(found.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb")), "alike")
    return _confirmed(found, sets, percent, hot_keys(found, ["a"]))


def _linked(classes: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, label): the component of every class that shares a bucket."""
    every = classes.select(F.posexplode("bands").alias("band", "key"), "node")
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    members = stage(every.join(shared, "key", "left_semi"), "members")
    info = stage(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "n", "sketch", "bands", "doc_id", "text_key"), "nodes")
    sets = stage(_sets(documents, info.select("node", "doc_id", "text_key"), size), "sets")
    labels = info.select("node", F.col("node").alias("label"))
    before, turn = None, 0
    while True:
        named = members.join(labels, "node")
        buckets = named.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("l"), F.max("label").alias("h"))
        buckets, (rows, pairs) = observed_stage(buckets.filter("l <> h").select("key", "members"), "buckets", F.sum("members"), F.sum(F.expr("members * (members - 1) / 2")))
        if not rows:
            return labels
        hot = hot_keys(members, ["key"], buckets.select("key", F.col("members").alias("rows")))
        apart = stage(join_hot(named, buckets.select("key"), ["key"], hot), "apart")
        last = turn > 0 and (pairs <= FEW_PAIRS * rows or pairs > before / 2)
        found = _left_links(apart, hot, buckets, info, sets, percent) if last else _star_links(apart, hot, info, sets, turn, percent)
        links, (n,) = observed_stage(found, "links", F.count(F.lit(1)))
        if n:
            roots = components(links.select(F.col("la").alias("a"), F.col("lb").alias("b"))).withColumnRenamed("node", "label")
            labels = stage(join_hot(labels, roots, ["label"], hot_keys(labels, ["label"]), "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        if last:
            return labels
        before, turn = pairs, turn + 1


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (and text_key, uid, root) of every row.

    component_id is the smallest doc_id that can be reached by links; kept says
    whether it is the row's own. Documents without words (null or empty texts)
    are linked with nothing. A null doc_id has no say in component_id, which is
    null only if all of a component are; so it doesn't name a component, but root
    does (null without words). Rows with equal doc_id are documents of their own
    that share a number. Texts of any length are compared whole. An empty table
    gives no rows; other columns take no part.
    """
    rows = stage(_signed(documents, size), "signatures")
    group = rows.filter("n > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("low"), F.min(F.struct("uid", "doc_id", "text_key", "n", "sketch", "bands")).alias("x"))
    classes = stage(group.select("set_a", "set_b", "low", F.col("x.uid").alias("node"), "x.doc_id", "x.text_key", "x.n", "x.sketch", "x.bands"), "classes")
    labels = _linked(classes, documents, size, percent)
    named = stage(classes.select("set_a", "set_b", "low", "node").join(labels, "node", "left").select("set_a", "set_b", "low", F.coalesce("label", "node").alias("root")), "named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = stage(join_hot(named.drop("low"), lowest, ["root"], hot_keys(named, ["root"])), "of_class")
    empty = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "text_key", "uid", F.lit(None).cast("long").alias("root"))
    worded = rows.filter("n > 0").select("doc_id", "n", "text_key", "uid", "set_a", "set_b")
    full = join_hot(worded, of_class, ["set_a", "set_b"], hot_keys(worded, ["set_a", "set_b"]))
    full = full.select("doc_id", "n", "component_id", "text_key", "uid", "root")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return full.union(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "text_key", "uid", "root")


def deduplicated(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; all columns as they were, whatever their names.

    Of rows that share that doc_id, the first by text digest stays, once. A null
    doc_id comes last. Documents without words all stay; an empty table gives no rows.
    """
    found = near_duplicates(documents, size, percent)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    alone = F.when(F.col("n_shingles") == 0, F.col("uid"))
    copies = found.groupBy("root", alone.alias("alone"), "doc_id", "text_key").agg(F.count(F.lit(1)).alias("c"))
    first = stage(copies.groupBy("root", "alone").agg(F.min(order).alias("k"), F.max("c").alias("c")), "kept")
    keys = first.select(F.col("k.doc_id").alias("id"), F.col("k.text_key").alias("key")).distinct()
    rows = packed(documents).withColumn("own_id", F.col("row")["doc_id"]).withColumn("own_key", F.xxhash64(F.col("row")["text"]))
    once = rows.join(keys, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left_semi")
    if not first.filter("c > 1").isEmpty():  # rows that repeat id and text
        words = F.coalesce(F.col("row")["text"].rlike(WORD), F.lit(False))
        once = once.withColumn("alone", F.when(~words, F.monotonically_increasing_id())).dropDuplicates(["own_id", "own_key", "alone"])
    return unpacked(once, documents.columns)
