"""Conforming volumes to an isotropic grid in the standard orientation, line by line.

The target grid keeps the directions of the source's, so what maps one to the
other is a scale and an offset along each axis: a resampling of lines, axis after
axis. Scans go by cubic B-splines, whose coefficients come from one recursion
forwards and one backwards along the line; masks by the nearest voxel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .blocks import AXES

#: The pole of the cubic B-spline's inverse filter, and what the filter is scaled by.
POLE = math.sqrt(3.0) - 2.0
GAIN = 6.0


def coefficients(line: Column) -> Column:
    """The cubic B-spline through a line, mirrored at its ends without repeating them."""

    def run(x: Column, n: Column) -> Column:
        z = F.lit(POLE)
        # The sum over the mirrored line without end, in closed form.
        ends = A.total(F.transform(x, lambda v, k: v * F.when((k > 0) & (k < n - 1), F.pow(z, k) + F.pow(z, 2 * n - 2 - k)).otherwise(F.pow(z, k))))
        first = GAIN * ends / (1 - F.pow(z, 2 * n - 2))
        push = lambda done, v: F.concat(done, F.array(v))
        forth = F.aggregate(F.slice(x, 2, n - 1), F.array(first), lambda done, v: push(done, GAIN * v + POLE * F.element_at(done, -1)))

        def back(c: Column) -> Column:
            last = (POLE * F.get(c, n - 2) + F.get(c, n - 1)) * (POLE / (POLE * POLE - 1))
            return F.reverse(F.aggregate(F.reverse(F.slice(c, 1, n - 1)), F.array(last), lambda done, v: push(done, POLE * (F.element_at(done, -1) - v))))

        return A.let(back, forth)

    return A.let(lambda x: F.when(F.size(x) > 1, A.let(lambda n: run(x, n), F.size(x))).otherwise(x), line)


def cubic(line: Column, places: Column) -> Column:
    """The line's spline at each place; 0 beyond its ends."""

    def run(c: Column, n: Column) -> Column:
        def mirrored(i: Column) -> Column:
            p = F.pmod(i, F.greatest(2 * n - 2, F.lit(1)))
            return F.get(c, F.when(p < n, p).otherwise(2 * n - 2 - p))

        def at(i: Column, t: Column) -> Column:
            u = 1 - t
            weights = (u * u * u, 4 - 6 * t * t + 3 * t * t * t, 4 - 6 * u * u + 3 * u * u * u, t * t * t)
            return sum((w / 6.0 * mirrored(i + d) for d, w in zip((-1, 0, 1, 2), weights, strict=True)), F.lit(0.0))

        def one(p: Column) -> Column:
            return F.when((p < 0) | (p > n - 1), 0.0).when(n == 1, F.get(c, 0)).otherwise(A.let(lambda i: at(i, p - i), F.floor(p).cast("int")))

        return F.transform(places, one)

    return A.let(lambda c: A.let(lambda n: run(c, n), F.size(c)), coefficients(line))


def nearest(line: Column, places: Column) -> Column:
    """The voxel nearest to each place, the later of two; null beyond the ends."""
    return A.let(lambda a: F.transform(places, lambda p: F.when((p >= 0) & (p <= F.size(a) - 1), F.get(a, F.least(F.floor(p + 0.5), F.size(a) - 1).cast("int")))), line)


def axes_of(affine: Column) -> Column:
    """Of each axis of the standard orientation (right, anterior, superior) the source's axis, whether it runs the other way, and its spacing.

    affine: 16 numbers in rows. World axes take source axes by the largest of the
    direction cosines that are left, as for a grid without much shear.
    """
    at = lambda r, c: F.get(affine, 4 * r + c)
    spacing = [F.sqrt(sum((at(r, c) * at(r, c) for r in range(3)), F.lit(0.0))) for c in range(3)]
    entry = lambda r, c: F.struct(F.abs(at(r, c) / spacing[c]).alias("size"), F.lit(-(3 * r + c)).alias("order"), F.lit(r).alias("world"), F.lit(c).alias("source"), (at(r, c) < 0).alias("flip"), spacing[c].alias("spacing"))
    entries = F.sort_array(F.array(*[entry(r, c) for r in range(3) for c in range(3)]), asc=False)
    none = F.filter(entries, lambda _: F.lit(False))
    free = lambda taken, e: ~F.exists(taken, lambda t: (t["world"] == e["world"]) | (t["source"] == e["source"]))
    chosen = F.aggregate(entries, none, lambda taken, e: F.when(free(taken, e), F.concat(taken, F.array(e))).otherwise(taken))
    return F.array_sort(F.transform(chosen, lambda e: F.struct(e["world"].alias("world"), e["source"].alias("source"), e["flip"].alias("flip"), e["spacing"].alias("spacing"))))


def target_affine(affine: Column, shape: Column, out_shape: tuple[int, int, int], mm: float) -> Column:
    """The 16 numbers of the target grid: the source's directions in standard order, `mm` long, with the middle voxel where it was."""

    def run(a: Column, own: Column) -> Column:
        at = lambda r, c: F.get(a, (4 * r + c).cast("int") if isinstance(c, Column) else F.lit(4 * r + c))
        steps, origin = [], [at(r, 3) for r in range(3)]
        for k in range(3):
            e = F.get(own, k)
            n = F.get(shape, e["source"])
            step = [F.when(e["flip"], -at(r, e["source"])).otherwise(at(r, e["source"])) for r in range(3)]
            middle = F.floor((n - 1) / 2)
            origin = [o + at(r, e["source"]) * F.when(e["flip"], n - 1 - middle).otherwise(middle) - step[r] * mm / e["spacing"] * ((out_shape[k] - 1) // 2) for r, o in enumerate(origin)]
            steps.append([s * mm / e["spacing"] for s in step])
        return F.array(*[x for r in range(3) for x in (*[steps[k][r] for k in range(3)], origin[r])], *[F.lit(float(x)) for x in (0, 0, 0, 1)])

    return A.let(run, affine, axes_of(affine))


def conform(voxels: DataFrame, grids: DataFrame, out_shape: tuple[int, int, int], mm: float, values: tuple[str, ...] = ("value",), masks: tuple[str, ...] = ("mask",)) -> DataFrame:
    """(case_id, i, j, k) of the target grid, with `values` by cubic splines and `masks` by the nearest voxel.

    voxels: a row for each voxel of full boxes; grids: (case_id, affine). The
    target runs right, anterior, superior, `out_shape` voxels of `mm`, its middle
    voxel on the source's. Beyond the source scans are 0 and masks false. Each
    axis is one shuffle of voxels into lines, and a line is all that a row holds.
    """
    case = grids.select("case_id", axes_of(F.col("affine")).alias("axes"))
    rows, fields = voxels.select("case_id", *AXES, *[F.col(v).cast("double").alias(v) for v in values], *masks), (*values, *masks)
    for source, own in enumerate(AXES):
        others = [a for a in AXES if a != own]
        lines = rows.groupBy("case_id", *others).agg(F.array_sort(F.collect_list(F.struct(own, *fields))).alias("line")).join(case, "case_id")
        # The target's axis that this one of the source becomes.
        axis = F.get(F.filter("axes", lambda e: e["source"] == source), 0)
        n, size = F.size("line"), F.element_at(F.array(*map(F.lit, out_shape)), axis["world"] + 1)
        middle = F.floor((n - 1) / 2)
        lines = lines.withColumns({"flip": axis["flip"], "scale": mm / axis["spacing"], "size": size, "middle": middle})
        place = lambda o: F.col("middle") + (o - F.floor((F.col("size") - 1) / 2)) * F.col("scale")
        places = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda o: F.when(F.col("flip"), F.size("line") - 1 - place(o)).otherwise(place(o)))
        lines = lines.withColumn("places", places)
        made = [cubic(F.col(f"line.{v}"), F.col("places")).alias(v) for v in values] + [F.transform(nearest(F.col(f"line.{m}"), F.col("places")), lambda x: F.coalesce(x, F.lit(False))).alias(m) for m in masks]
        lines = lines.select("case_id", *others, F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda o: o).alias(own), *made)
        rows = lines.select("case_id", *others, F.explode(F.arrays_zip(own, *fields)).alias("c")).select("case_id", *others, *[F.col(f"c.{f}").alias(f) for f in (own, *fields)])
    # Places along the source's axes are places along the target's by now, under the source's names.
    by_world = lambda w: F.element_at(F.array(*AXES), F.get("axes", w)["source"] + 1)
    return rows.join(case, "case_id").select("case_id", *[by_world(w).alias(f"_{a}") for w, a in enumerate(AXES)], *fields).select("case_id", *[F.col(f"_{a}").alias(a) for a in AXES], *fields)
