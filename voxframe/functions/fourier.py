"""The discrete Fourier transform of array columns: radix steps as index remaps, any other length by a chirp.

A complex array is an array of structs (re, im). Each of the log2(n) steps remaps
the array once; a length that is no power of two becomes a convolution with a
chirp, of the next power of two from 2 * n - 1. Lengths are those of each row.
Spark interprets these steps place by place; for many rows line_spectra() has NumPy do them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let


def pair(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def turn(angle: Column) -> Column:
    """exp(i * angle)."""
    return pair(F.cos(angle), F.sin(angle))


def times(a: Column, b: Column) -> Column:
    return pair(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def complex_array(re: Column) -> Column:
    return F.transform(re, lambda x: pair(x.cast("double"), F.lit(0.0)))


def real(z: Column) -> Column:
    return F.transform(z, lambda c: c["re"])


def magnitude(z: Column) -> Column:
    return F.transform(z, lambda c: F.hypot(c["re"], c["im"]))


def _levels(n: Column) -> Column:
    """log2 of a power of two, exactly."""
    return F.length(F.bin(n)) - 1


def _steps(n: Column) -> Column:
    """0 .. log2(n) - 1; empty for n = 1."""
    return F.when(n > 1, F.sequence(F.lit(0), (_levels(n) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _radix(z: Column, sign: int) -> Column:
    """The sum over x of z[x] * exp(sign * 2 pi i x k / n) of an array whose length is a power of two."""

    def run(a: Column, n: Column) -> Column:
        order = F.aggregate(_steps(n), F.array(F.lit(0)), lambda o, _: F.concat(F.transform(o, lambda x: 2 * x), F.transform(o, lambda x: 2 * x + 1)))
        twiddles = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(n / 2), F.lit(1)) - 1), lambda k: turn(sign * 2 * math.pi * k / n))

        def merged(o: Column, w: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                half = F.call_function("shiftleft", F.lit(1), s)

                def butterfly(x: Column, at: Column) -> Column:
                    """The sum of a place and its turned partner in the upper half, the difference in the lower."""
                    upper = at % (2 * half) < half
                    y = F.get(acc, F.when(upper, at + half).otherwise(at - half))
                    t = F.get(w, ((at % half) * (n / (2 * half))).cast("int"))
                    return F.when(upper, pair(x["re"] + t["re"] * y["re"] - t["im"] * y["im"], x["im"] + t["re"] * y["im"] + t["im"] * y["re"])).otherwise(
                        pair(y["re"] - t["re"] * x["re"] + t["im"] * x["im"], y["im"] - t["re"] * x["im"] - t["im"] * x["re"])
                    )

                return F.transform(acc, butterfly)

            return F.aggregate(_steps(n), F.transform(o, lambda at: F.get(a, at)), step)

        return let(merged, order, twiddles)

    return let(lambda a: let(lambda n: run(a, n), F.size(a)), z)


def _chirp(z: Column, sign: int) -> Column:
    """The same for any length: x k = (x^2 + k^2 - (k - x)^2) / 2 makes it a convolution."""

    def run(a: Column, n: Column, m: Column) -> Column:
        def wave(k: Column, s: int) -> Column:
            # Squares modulo 2 n keep the angles small and exact.
            return turn(s * math.pi * (k.cast("long") * k % (2 * n)) / n)

        zero = pair(F.lit(0.0), F.lit(0.0))
        places = F.sequence(F.lit(0), m - 1)
        own = F.transform(places, lambda k: F.when(k < n, times(F.get(a, k), wave(k, sign))).otherwise(zero))
        kernel = F.transform(places, lambda k: F.when(k < n, wave(k, -sign)).when(k > m - n, wave(m - k, -sign)).otherwise(zero))

        def product(x: Column, y: Column) -> Column:
            return F.zip_with(x, y, times)

        def back(c: Column) -> Column:
            return F.transform(F.slice(c, 1, n), lambda v, k: times(pair(v["re"] / m, v["im"] / m), wave(k, sign)))

        return let(back, _radix(let(product, _radix(own, -1), _radix(kernel, -1)), 1))

    widest = lambda n: F.pow(F.lit(2.0), F.ceil(F.log2(2.0 * n - 1))).cast("int")
    return let(lambda a: let(lambda n: let(lambda m: run(a, n, m), widest(n)), F.size(a)), z)


def _transform(z: Column, sign: int) -> Column:
    def run(a: Column) -> Column:
        n = F.size(a)
        even = F.bit_count(n) == 1
        return F.when(n == 0, a).when(even, _radix(a, sign)).otherwise(_chirp(a, sign))

    return let(run, z)


def fft(z: Column) -> Column:
    """Of a complex array; empty for an empty one, null for null."""
    return _transform(z, -1)


def ifft(z: Column) -> Column:
    return let(lambda a: F.transform(a, lambda c: pair(c["re"] / F.size(a), c["im"] / F.size(a))), _transform(z, 1))


def line_spectra(rows: DataFrame, values: str, lines: int = 1024) -> DataFrame:
    """The rows with `re` and `im` of fft() of the array<double> column `values`, by NumPy, up to so many rows at a time.

    Null lines give nulls, a line that holds a null gives nulls at all its places, an empty line gives empty arrays.
    """

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = batch.column(values)
        sizes = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = found.flatten()
        x, holes = flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        z, gone = np.empty(len(x), complex), np.zeros(len(x), bool)
        for n in set(sizes.tolist()) - {0}:
            places = (ends[sizes == n] - n)[:, None] + np.arange(n)
            z[places] = np.fft.fft(x[places], axis=1)
            gone[places] = holes[places].any(axis=1, keepdims=True)
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        made = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.float64(), mask=gone), mask=found.is_null()) for v in (z.real, z.imag)]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "re", "im"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, lines):
                yield part(batch.slice(at, lines))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kept}, re array<double>, im array<double>")


def frequency(k: Column, n: Column) -> Column:
    """The whole frequency of a place in a transform of length n: 0, 1, ..., then the negative ones."""
    return F.when(2 * k < n, k).otherwise(k - n)
