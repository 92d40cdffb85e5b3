"""Statistics of array columns within their row: no explode, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(body: Callable[..., Column], *values: Column) -> Column:
    """body(values), each value computed once for the row however often the body names it,
    even from lambdas over the voxels. Without this, Spark computes a statistic anew for each voxel."""
    bound = F.struct(*[v.alias(f"v{k}") for k, v in enumerate(values)])
    return F.get(F.transform(F.array(bound), lambda s: body(*[s[f"v{k}"] for k in range(len(values))])), 0)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """Null for an empty array."""
    return let(lambda v: F.when(F.size(v) > 0, total(v) / F.size(v)), a)


def std(a: Column) -> Column:
    """Population standard deviation in two passes; null for an empty array."""
    return let(lambda v: let(lambda m: F.sqrt(mean(F.transform(v, lambda x: (x - m) * (x - m)))), mean(v)), a)


def percentile(a: Column, q: float | Column) -> Column:
    """Exact, interpolated linearly between order statistics; null for an empty array."""
    return percentiles(a, q)[0]


def percentiles(a: Column, *qs: float | Column) -> list[Column]:
    """Several percentiles; each sorts by itself unless the array was sorted before."""

    def one(q: float | Column) -> Column:
        def pick(s: Column, at: Column) -> Column:
            low = F.floor(at).cast("int")
            x, y = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
            return F.when(F.size(s) > 0, x + (y - x) * (at - low))

        return let(lambda s: let(pick, s, (F.size(s) - 1) * (q if isinstance(q, Column) else F.lit(float(q))) / 100.0), F.array_sort(a))

    return [one(q) for q in qs]


def median(a: Column) -> Column:
    return percentile(a, 50.0)


def where(a: Column, mask: Column, test: Callable[[Column, Column], Column]) -> Column:
    """The elements x with their mask m for which test(x, m) holds."""
    pairs = F.arrays_zip(a.alias("x"), mask.alias("m"))
    return F.transform(F.filter(pairs, lambda p: test(p["x"], p["m"])), lambda p: p["x"])


def positives(a: Column) -> Column:
    return F.filter(a, lambda x: x > 0)


def histogram(a: Column, bins: int) -> Column:
    """Counts of values in [0, 1] in equal bins, the last one closed."""
    places = F.transform(a, lambda x: F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int"))
    return let(lambda at: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(at, lambda p: p == b))), places)


def try_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
