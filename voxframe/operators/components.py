"""Connected components of masks that no row holds: runs of voxels, links between runs, alternating stars.

A run is an unbroken stretch of a line along k. Runs of neighbouring lines that
touch are linked, and the links are contracted to stars round the first run of
each component, so what is shuffled are runs and links, never voxels in pairs.
Joins are by merges: what is small on disk, or for one round, may be large in
memory, and broadcasts of it all pass through the driver.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import observed_stage, stage
from .blocks import AXES, shapes

#: Runs meet within stretches of so many places, however long the lines are.
STRETCH = 32
#: A component smaller than this share of the case's largest is dropped, and said to be so from this share on.
KEEP_RATIO, NOTE_RATIO = 0.05, 0.02


def voxel_number(i: Column, j: Column, k: Column) -> Column:
    """One long for a place, in C order, for axes of up to two million voxels."""
    return (i.cast("long") * (1 << 21) + j) * (1 << 21) + k


def runs(voxels: DataFrame, mask: str = "mask") -> DataFrame:
    """(case_id, i, j, first, last, run): the runs of true voxels; run numbers the first voxel."""
    order = Window.partitionBy("case_id", "i", "j").orderBy("k")
    true = voxels.filter(F.coalesce(F.col(mask), F.lit(False))).select("case_id", *AXES, (F.col("k") - F.row_number().over(order)).alias("island"))
    made = true.groupBy("case_id", "i", "j", "island").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    return made.select("case_id", "i", "j", "first", "last", voxel_number(F.col("i"), F.col("j"), F.col("first")).alias("run"))


def links(found: DataFrame, full: bool = True) -> DataFrame:
    """(case_id, u, v): the pairs of touching runs, by faces alone or by edges and corners too (full)."""
    reach = 1 if full else 0
    later = [d for d in itertools.product((0, 1), (-1, 0, 1)) if d > (0, 0) and (full or 0 in d)]
    stretch = lambda a, b: F.explode(F.sequence(F.floor(a / STRETCH), F.floor(b / STRETCH)))
    near = F.array(*[F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di, dj in later])
    own = found.select("case_id", "i", "j", (F.col("first") - reach).alias("a"), (F.col("last") + reach).alias("b"), F.col("run").alias("u"), F.explode(near).alias("d"))
    own = own.select("case_id", (F.col("i") + F.col("d.di")).alias("i"), (F.col("j") + F.col("d.dj")).alias("j"), "a", "b", "u", stretch(F.col("a"), F.col("b")).alias("s"))
    other = found.select("case_id", "i", "j", "first", "last", F.col("run").alias("v"), stretch(F.col("first"), F.col("last")).alias("s"))
    met = own.join(other.hint("merge"), ["case_id", "i", "j", "s"]).filter("first <= b AND last >= a")
    # Runs that share several stretches are linked in the first of them.
    return met.filter(F.floor(F.greatest("a", "first") / STRETCH) == F.col("s")).select("case_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its least neighbour."""
    both = edges.unionByName(edges.select("case_id", F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("case_id", "u").agg(F.min("v").alias("m")).select("case_id", "u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least.hint("merge"), ["case_id", "u"]).select("case_id", F.col("m").alias("u"), "v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them."""
    own = edges.select("case_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    least = own.groupBy("case_id", "v").agg(F.min("u").alias("m"))
    moved = own.join(least.hint("merge"), ["case_id", "v"]).filter("u > m").select("case_id", F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(least.select("case_id", F.col("m").alias("u"), "v")).distinct()


def contract(edges: DataFrame) -> DataFrame:
    """(case_id, v, u): of each node v that isn't the least of its component, the least one u, from links (case_id, u, v) with u < v.

    Large and small stars alternate until nothing changes, in about log^2 rounds
    at most; each round is written to the shared folder. A star's centre is one
    key of the joins, which Spark's adaptive plans split, and all aggregates
    combine before they shuffle.
    """
    mark = (F.count(F.lit(1)), F.sum(F.xxhash64("case_id", "u", "v").cast("decimal(38,0)")))
    edges, before = observed_stage(edges.distinct(), "links", *mark)
    while before[0]:
        edges, now = observed_stage(_small_star(_large_star(edges)), "stars", *mark)
        if now == before:
            break
        before = now
    return edges.select("case_id", "v", "u")


def component_runs(voxels: DataFrame, mask: str = "mask", full: bool = True) -> DataFrame:
    """runs() with `component`, the number of the component's first voxel. Components of different cases never meet."""
    found = stage(runs(voxels, mask), "runs")
    stars = contract(links(found, full)).select("case_id", F.col("v").alias("run"), F.col("u").alias("component"))
    return found.join(stars.hint("merge"), ["case_id", "run"], "left").withColumn("component", F.coalesce("component", "run"))


def component_sizes(voxels: DataFrame, mask: str = "mask", full: bool = True, keep_ratio: float = KEEP_RATIO) -> DataFrame:
    """(case_id, component, size, kept, noted): kept if not smaller than keep_ratio of the case's largest; noted if dropped though not a speck."""
    return _judged(component_runs(voxels, mask, full), keep_ratio)


def _judged(found: DataFrame, keep_ratio: float) -> DataFrame:
    sizes = found.groupBy("case_id", "component").agg(F.sum(F.col("last") - F.col("first") + 1).alias("size"))
    largest = sizes.groupBy("case_id").agg(F.max("size").alias("largest"))
    kept = F.col("size") >= keep_ratio * F.col("largest")
    return sizes.join(largest.hint("merge"), "case_id").select("case_id", "component", "size", kept.alias("kept"), (~kept & (F.col("size") >= NOTE_RATIO * F.col("largest"))).alias("noted"))


def _voxels(found: DataFrame) -> DataFrame:
    """(case_id, i, j, k) of the voxels of runs."""
    return found.select("case_id", "i", "j", F.explode(F.sequence("first", "last")).alias("k"))


def cleaned(voxels: DataFrame, mask: str = "mask", keep_ratio: float = KEEP_RATIO) -> DataFrame:
    """(case_id, i, j, k, mask, noted) of every voxel: small components dropped, then holes filled.

    Components touch by faces, edges or corners; a hole is background that
    doesn't reach the volume's border by faces. noted: a dropped component of the
    case was no speck. A null mask is false; a case without true voxels stays so.
    """
    found = stage(component_runs(voxels, mask), "components")
    judged = stage(_judged(found, keep_ratio), "judged")
    kept = _voxels(found.join(judged.filter("kept").select("case_id", "component").hint("merge"), ["case_id", "component"], "left_semi"))
    noted = judged.groupBy("case_id").agg(F.bool_or("noted").alias("noted"))
    main = stage(voxels.select("case_id", *AXES).join(kept.withColumn("inside", F.lit(True)).hint("merge"), ["case_id", *AXES], "left").withColumn("inside", F.coalesce("inside", F.lit(False))), "kept")

    outside = component_runs(main.withColumn("outside", ~F.col("inside")), "outside", full=False)
    outside = stage(outside.join(shapes(voxels).hint("merge"), "case_id"), "outside")
    border = (F.col("i") == 0) | (F.col("i") == F.col("ni") - 1) | (F.col("j") == 0) | (F.col("j") == F.col("nj") - 1) | (F.col("first") == 0) | (F.col("last") == F.col("nk") - 1)
    closed = outside.groupBy("case_id", "component").agg(F.bool_or(border).alias("open")).filter("NOT open")
    holes = _voxels(outside.join(closed.hint("merge"), ["case_id", "component"], "left_semi")).withColumn("hole", F.lit(True))
    full = main.join(holes.hint("merge"), ["case_id", *AXES], "left").join(noted.hint("merge"), "case_id", "left")
    return full.select("case_id", *AXES, (F.col("inside") | F.coalesce("hole", F.lit(False))).alias("mask"), F.coalesce("noted", F.lit(False)).alias("noted"))
