"""Random draws as Column expressions.

A draw is a function of a key (seed, case, operator, name of the draw, voxel)
and of nothing else, so results don't depend on partitioning or row order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts) -> Column:
    return F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def uniform(*parts) -> Column:
    """In [0, 1): the first 32 bits of the key's SHA-256 over 2**32."""
    return F.conv(F.substring(F.sha2(key(*parts).cast("binary"), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def between(low: float, high: float, *parts) -> Column:
    return low + (high - low) * uniform(*parts)


def integer(low: int, high: int, *parts) -> Column:
    """low..high, both included."""
    return (low + F.floor(uniform(*parts) * (high - low + 1))).cast("int")


def normal(*parts) -> Column:
    """Standard normal by Box and Muller."""
    u = F.greatest(uniform(*parts, "a"), F.lit(2.0**-33))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(*parts, "b"))


def choice(draw: Column, weights: dict[str, float]) -> Column:
    """The first name whose running share of the weights exceeds the draw; the last if none does."""
    total, running, out = math.fsum(weights.values()), 0.0, None
    for name, w in list(weights.items())[:-1]:
        running += w / total
        hit = draw < F.lit(running)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    last = F.lit(list(weights)[-1])
    return last if out is None else out.otherwise(last)


def trial_seed_hex(*parts: Column) -> Column:
    """First eight bytes, as hexadecimal digits, of the SHA-256 of the parts as a JSON list.

    Strings are given as quoted by `json_string`; read as a little-endian
    integer it is a trial's unsigned 64-bit seed, which a BIGINT can't hold.
    """
    text = F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def json_string(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c.cast("string"), r'(["\\])', r"\\$1"), F.lit('"'))
