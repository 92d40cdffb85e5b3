"""The halving search and its gates against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.operators import primitives as P
from voxframe.operators import style


def gates(x, z):
    ga, gb = np.stack(np.gradient(x)), np.stack(np.gradient(z))
    n = np.sqrt((ga**2).sum(0))
    if n.max() <= 1e-8:
        aligned = 1.0 if np.sqrt((gb**2).sum(0)).max() <= 1e-8 else 0.0
    else:
        w = np.clip(n - np.quantile(n, 0.6), 0, None)
        w = w if w.sum() > 1e-8 else n
        aligned = (w * (ga * gb).sum(0) / np.maximum(n * np.sqrt((gb**2).sum(0)), 1e-10)).sum() / w.sum()
    a, b = ((v - P.gaussian(v, 0.8)).ravel() for v in (x, z))
    a, b = a - a.mean(), b - b.mean()
    d = np.linalg.norm(a) * np.linalg.norm(b)
    return aligned, a @ b / d if d > 1e-8 else float(b.std() <= 1e-8), ((z == 0) & (x != 0)).mean()


def plain(x, y):
    for k in range(8):
        z = np.clip(x + 2.0**-k * (y - x), 0, 1)
        z[x == 0] = 0
        a, c, n = gates(x, z)
        if a >= 0.96 and c >= 0.94 and n <= 1e-4:
            return z, 2.0**-k, a, c
    return x, 0.0, 1.0, 1.0


def test_search(spark):
    g = np.random.default_rng(5)
    shape, rows, want = (5, 4, 6), [], {}
    for n, w in enumerate((0.0, 0.05, 0.1, 0.2, 0.4, 0.8, 1.0, 1.0)):
        x = g.random(shape)
        x[0, 0] = 0.0
        y = np.clip((1 - w) * x**0.8 + w * g.random(shape), 0, 1) if n < 7 else 1 - x
        rows.append((n, x.ravel().tolist(), y.ravel().tolist(), list(shape)))
        want[n] = plain(x, y)
    rows += [(20, [0.5] * 120, [0.5] * 120, list(shape)), (21, None, [0.5] * 120, list(shape)), (22, [0.5] * 120, [0.5] * 3, list(shape))]
    table = spark.createDataFrame(rows, "case_id int, voxels array<double>, candidate array<double>, shape array<int>").withColumn("label", F.lit(1))
    got = {r["case_id"]: r for r in style.search(table, "candidate").collect()}
    for n, (z, step, a, c) in want.items():
        assert got[n]["step"] == step and np.allclose(got[n]["voxels"], z.ravel())
        assert (got[n]["alignment"], got[n]["correlation"]) == pytest.approx((a, c))
    assert len({w[1] for w in want.values()}) >= 3
    assert got[20]["step"] == 1.0 and got[20]["voxels"] == [0.5] * 120
    assert got[21]["step"] is None and got[21]["voxels"] is None and got[22]["step"] is None and got[22]["voxels"] == [0.5] * 120
