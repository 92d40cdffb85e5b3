"""Volumes too large for a row: voxel rows, boxes of them with halos, and lines.

A voxel table has a row for each voxel: case_id, i, j, k and its values. A block
table has a row for each box of `size` voxels a side, `cells` in C order. Blocks
send the voxels near their faces to the neighbours, so a step that looks `width`
voxels around sees the same neighbourhood whatever the blocks' size, and no row,
task or group holds more than a box with its halo, or a line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

AXES = ("i", "j", "k")
SIZE = 32


def shapes(voxels: DataFrame) -> DataFrame:
    """(case_id, ni, nj, nk) of full boxes of voxels that start at 0."""
    return voxels.groupBy("case_id").agg(*[(F.max(a) + 1).alias(f"n{a}") for a in AXES])


def with_halos(voxels: DataFrame, size: int = SIZE, width: int = 1) -> DataFrame:
    """(case_id, bi, bj, bk, low, high, cells): each block with the voxels up to `width` beyond its faces, edges and corners.

    low and high bound the block's own voxels; cells holds structs of all columns
    of `voxels`, in C order of the widened box, which ends where the volume does.
    One shuffle: a voxel is sent to its block, and once more to each neighbour
    whose halo it lies in. width must not exceed size.
    """
    if not 0 <= width <= size:
        raise ValueError("a halo reaches no farther than the next block")
    own = [c for c in voxels.columns if c != "case_id"]

    def homes(a: str) -> Column:
        """The blocks along an axis that see this place: its own, and a neighbour near the face."""
        b, at = F.floor(F.col(a) / size).cast("int"), F.pmod(F.col(a), F.lit(size))
        before, after = F.when((at < width) & (b > 0), b - 1), F.when(at >= size - width, b + 1)
        return F.filter(F.array(before, b, after), lambda x: x.isNotNull())

    sent = voxels
    for a in AXES:
        sent = sent.withColumn(f"b{a}", F.explode(homes(a)))
    inside = F.lit(True)
    for a in AXES:
        inside &= F.col(f"b{a}") == F.floor(F.col(a) / size)
    cell = F.struct(*AXES, *[c for c in own if c not in AXES])
    made = sent.groupBy("case_id", *[f"b{a}" for a in AXES]).agg(
        F.sort_array(F.collect_list(cell)).alias("cells"), *[F.min(F.when(inside, F.col(a))).alias(f"low_{a}") for a in AXES], *[F.max(F.when(inside, F.col(a))).alias(f"high_{a}") for a in AXES]
    )
    # A neighbour beyond the volume's end has no voxels of its own.
    made = made.filter(F.col("low_i").isNotNull())
    return made.select("case_id", *[f"b{a}" for a in AXES], F.array(*[f"low_{a}" for a in AXES]).alias("low"), F.array(*[f"high_{a}" for a in AXES]).alias("high"), "cells")


class Halo:
    """Lookups by offset within a block's cells."""

    def __init__(self, cells: Column):
        self.cells = cells
        first, last = F.get(cells, 0), F.get(cells, F.size(cells) - 1)
        self.first = [first[a] for a in AXES]
        self.span = [last[a] - first[a] + 1 for a in AXES]

    def at(self, cell: Column, offset: tuple[int, int, int]) -> Column:
        """The cell at an offset; null beyond the volume. An offset beyond the halo must not be asked for."""
        place, inside = [], F.lit(True)
        for a, first, n, d in zip(AXES, self.first, self.span, offset, strict=True):
            p = cell[a] - first + d
            if d:
                inside &= (p >= 0) & (p < n)
            place.append(p)
        index = (place[0] * self.span[1] + place[1]) * self.span[2] + place[2]
        return F.when(inside, F.get(self.cells, index.cast("int")))


def own_cells(function: Callable[[Halo, Column], Column]) -> Column:
    """function(halo, cell) of each of a block's own cells, in order."""

    def run(cells: Column, low: Column, high: Column) -> Column:
        def is_own(c: Column) -> Column:
            inside = F.lit(True)
            for n, a in enumerate(AXES):
                inside &= c[a].between(F.get(low, n), F.get(high, n))
            return inside

        return F.transform(F.filter(cells, is_own), lambda c: function(Halo(cells), c))

    return A.let(run, F.col("cells"), F.col("low"), F.col("high"))


#: Cells that a kernel over blocks takes at a time, or one block.
CELLS = 1 << 18


def _least_determinants(blocks: pa.RecordBatch) -> np.ndarray:
    """Of each block, the least determinant of p -> p + (di, dj, dk) at its own cells; minus infinity if one isn't finite."""
    cells, bounds = blocks.column("cells"), [np.asarray(blocks.column(c).flatten()).reshape(-1, 3) for c in ("low", "high")]
    sizes = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts, own = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    field = dict(zip([f.name for f in cells.type.value_type], cells.flatten().flatten(), strict=True))
    at = np.stack([np.asarray(field[a], np.int64) for a in AXES])
    values = np.stack([np.asarray(field[f], float) for f in ("di", "dj", "dk")])
    first, last = np.minimum.reduceat(at, starts, axis=1), np.maximum.reduceat(at, starts, axis=1)
    # Blocks of the same shape, whose own cells lie alike, are taken together.
    kinds, kind = np.unique(np.hstack([(last - first + 1).T, bounds[0] - first.T, bounds[1] - first.T]), axis=0, return_inverse=True)
    kind, out = kind.ravel(), np.full(len(sizes), -np.inf)
    for number, (*span, li, lj, lk, hi, hj, hk) in enumerate(kinds.tolist()):
        if min(span) < 2:
            continue  # no difference along an axis of one voxel
        rows = np.flatnonzero(kind == number)
        mine = np.flatnonzero(kind[own] == number)
        grid = np.full((3, len(rows), *span), np.nan)
        grid[:, np.searchsorted(rows, own[mine]), *(at[:, mine] - first[:, own[mine]])] = values[:, mine]
        with np.errstate(all="ignore"):
            x, y, z = [[g + (a == c) for a, g in enumerate(np.gradient(grid[c], axis=(1, 2, 3)))] for c in range(3)]
            d = x[0] * (y[1] * z[2] - y[2] * z[1]) - x[1] * (y[0] * z[2] - y[2] * z[0]) + x[2] * (y[0] * z[1] - y[1] * z[0])
        d = d[:, li : hi + 1, lj : hj + 1, lk : hk + 1].reshape(len(rows), -1)
        out[rows] = np.where(np.isfinite(d).all(axis=1), d.min(axis=1), -np.inf)
    return out


def jacobian_minimum(voxels: DataFrame, size: int = SIZE) -> DataFrame:
    """(case_id, least): the least determinant of the map p -> p + (di, dj, dk) of each case.

    voxels: case_id, i, j, k, di, dj, dk. Differences are central, one-sided at
    the volume's faces. A case with a null or non-finite displacement, or with an
    axis of fewer than two voxels, gives minus infinity, so it can never be
    accepted. An empty table gives no rows.
    """
    fields = ("di", "dj", "dk")
    blocks = with_halos(voxels.select("case_id", *AXES, *[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f) for f in fields]), size, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            step = max(1, CELLS // max(batch.column("cells").value_lengths().to_pylist()))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                yield pa.RecordBatch.from_arrays([part.column("case_id"), pa.array(_least_determinants(part))], names=["case_id", "least"])

    each = blocks.select("case_id", "low", "high", "cells").mapInArrow(run, f"case_id {voxels.schema['case_id'].dataType.simpleString()}, least double")
    return each.groupBy("case_id").agg(F.min("least").alias("least"))


def boundary_band(voxels: DataFrame, radius: int = 2, size: int = SIZE) -> DataFrame:
    """(case_id, i, j, k, band): the voxels whose box of `radius` holds true and false ones of `mask`; a null counts as false.

    The border of the volume is no boundary. The box is searched an axis at a
    time: three passes over the block, each of 2 * radius + 1 places.
    """
    blocks = with_halos(voxels.select("case_id", *AXES, F.coalesce("mask", F.lit(False)).alias("mask")), size, radius)

    def spread(cells: Column, axis: int) -> Column:
        def near(c: Column) -> Column:
            found = []
            for d in range(-radius, radius + 1):
                step = [0, 0, 0]
                step[axis] = d
                found.append(Halo(cells).at(c, tuple(step)))
            some = [F.reduce(F.array(*[x[f] for x in found]), F.lit(False), lambda s, v: s | F.coalesce(v, F.lit(False))).alias(f) for f in ("yes", "no")]
            return F.struct(*[c[a].alias(a) for a in AXES], *some)

        return F.transform(cells, near)

    both = F.transform("cells", lambda c: F.struct(*[c[a].alias(a) for a in AXES], c["mask"].alias("yes"), (~c["mask"]).alias("no")))
    cells = A.let(lambda x: A.let(lambda y: A.let(lambda z: spread(z, 2), spread(y, 1)), spread(x, 0)), both)
    wide = blocks.withColumn("cells", cells)
    each = wide.select("case_id", F.explode(own_cells(lambda _, c: F.struct(*[c[a].alias(a) for a in AXES], (c["yes"] & c["no"]).alias("band")))).alias("c"))
    return each.select("case_id", "c.*")


# lines


def _lines(voxels: DataFrame, axis: int, fields: list[str]) -> DataFrame:
    """A row for each line along an axis: the other two places, and `line`, the structs of the fields in order."""
    others = [a for k, a in enumerate(AXES) if k != axis]
    return voxels.groupBy("case_id", *others).agg(F.array_sort(F.collect_list(F.struct(AXES[axis], *fields))).alias("line"))


def lower_envelope(values: Column, spacing: float) -> Column:
    """Of a line f of squared distances, min over q of f(q) + (spacing * (p - q))^2 for each place p, infinite if all are.

    The parabolas that show in the lower envelope are kept on a stack, each with
    the place from which it is the lowest. A new one, rooted farther right, hides
    those at whose starts it is lower already, which are the stack's end. So
    memory follows the line's length, and the envelope is read off piece by piece.
    """
    s2 = float(spacing) ** 2
    none = F.array().cast("array<struct<q:int,f:double,z:double>>")

    def put(stack: Column, q: Column, f: Column) -> Column:
        def crossing(e: Column) -> Column:
            """Where the parabola of q gets lower than the earlier one of e, in voxels."""
            return (f - e["f"] + s2 * (q * q - e["q"] * e["q"])) / (2 * s2 * (q - e["q"]))

        def add(kept: Column) -> Column:
            start = F.when(F.size(kept) > 0, crossing(F.get(kept, F.size(kept) - 1))).otherwise(float("-inf"))
            return F.concat(kept, F.array(F.struct(q.alias("q"), f.alias("f"), start.alias("z"))))

        return A.let(add, F.filter(stack, lambda e: crossing(e) > e["z"]))

    def build(line: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(line) - 1)
        return F.aggregate(places, none, lambda stack, q: A.let(lambda f: F.when(f < float("inf"), put(stack, q, f)).otherwise(stack), F.get(line, q)))

    def read(line: Column, stack: Column) -> Column:
        n = F.size(line)

        def piece(e: Column, t: Column) -> Column:
            """The places from where e is the lowest to where the next one is."""
            bounded = lambda z: F.least(F.greatest(F.ceil(z), F.lit(0)), n).cast("int")
            following = F.get(stack, t + 1)["z"]
            first, after = bounded(e["z"]), F.when(following.isNull(), n).otherwise(bounded(following))
            inside = F.when(after > first, F.sequence(first, after - 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(inside, lambda p: e["f"] + s2 * (p - e["q"]) * (p - e["q"]))

        return F.when(F.size(stack) > 0, F.flatten(F.transform(stack, piece))).otherwise(F.array_repeat(F.lit(float("inf")), n))

    return A.let(lambda line: A.let(lambda stack: read(line, stack), build(line)), values)


def signed_distance(voxels: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(case_id, i, j, k, mask, distance): exact Euclidean distance to the nearest voxel of the other kind, positive outside the mask.

    0 everywhere in a case whose mask is empty or full, which has no boundary. A
    null mask counts as false. Each axis is one shuffle of the voxels into lines.
    """
    inf = F.lit(float("inf"))
    own = F.coalesce("mask", F.lit(False))
    rows = voxels.select("case_id", *AXES, own.alias("mask"), F.when(own, 0.0).otherwise(inf).alias("to_true"), F.when(own, inf).otherwise(0.0).alias("to_false"))
    fields = ["mask", "to_true", "to_false"]
    for axis, step in enumerate(spacing):
        lines = _lines(rows, axis, fields)
        # An array of structs, asked for a field, is the array of the field.
        others, env = [a for a in AXES if a != AXES[axis]], [lower_envelope(F.col(f"line.{f}"), step).alias(f) for f in fields[1:]]
        lines = lines.select("case_id", *others, *[F.col(f"line.{f}").alias(f) for f in (AXES[axis], "mask")], *env)
        rows = lines.select("case_id", *others, F.explode(F.arrays_zip(AXES[axis], *fields)).alias("c")).select("case_id", *others, *[F.col(f"c.{f}").alias(f) for f in (AXES[axis], *fields)])
    signed = F.sqrt("to_true") - F.sqrt("to_false")
    return rows.select("case_id", *AXES, "mask", F.when((F.col("to_true") == inf) | (F.col("to_false") == inf), 0.0).otherwise(signed).alias("distance"))

