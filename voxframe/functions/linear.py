"""Small linear systems within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

#: A pivot below this part of the largest entry counts as none.
SINGULAR = 1e-14


def solve(system: Column) -> Column:
    """x of a system given as rows of coefficients with the right side last: Gauss and Jordan with row pivots; null if it is singular or holds a null."""

    def step(m: Column, k: Column, least: Column) -> Column:
        n = F.size(m)
        at = lambda r, c: F.get(F.get(m, r), c)
        # The largest entry of the column from row k on; of equal ones the first.
        best = F.array_max(F.transform(F.sequence(k, n - 1), lambda r: F.struct(F.abs(at(r, k)).alias("size"), (-r).alias("row"))))

        def eliminated(size: Column, p: Column) -> Column:
            def by(pivot: Column) -> Column:
                def one(row: Column, r: Column) -> Column:
                    other = F.when(r == p, F.get(m, k)).otherwise(row)
                    return let(lambda o: F.zip_with(o, pivot, lambda x, y: x - F.get(o, k) * y), other)

                return F.transform(m, lambda row, r: F.when(r == k, pivot).otherwise(one(row, r)))

            return F.when(size > least, let(by, let(lambda row: F.transform(row, lambda x: x / F.get(row, k)), F.get(m, p))))

        return let(lambda b: eliminated(b["size"], (-b["row"]).cast("int")), best)

    def run(a: Column, least: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), a, lambda m, k: F.when(m.isNotNull(), step(m, k, least)))

    largest = lambda a: F.array_max(F.transform(F.flatten(a), F.abs)) * SINGULAR
    whole = lambda a: F.when(F.forall(F.flatten(a), lambda x: x.isNotNull()), a)
    return let(lambda a: let(lambda s: F.when(s.isNotNull(), F.transform(s, lambda row: F.element_at(row, -1))), let(run, a, largest(a))), whole(system))
