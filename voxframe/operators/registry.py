"""The operator registry and how operators are applied to a DataFrame of volumes.

An operator is lowered in one of three ways. `column`: a function of a ColumnVolume
that gives the new voxels as a Column; it stays in the JVM. `kernel`: a function
of a NumPy array, run in Arrow batches. Either way rows go one by one: applying
such an operator never shuffles. `job`: a function of a DataFrame of volumes, for
work that is dealt out by slices or lines and shuffles them.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import arrays as A
from ..functions import draws
from ..functions.staging import stage

KINDS = ("geometry", "intensity", "noise", "kspace", "focal", "structure", "meta")
DIMS = ("2d", "3d", "either")
RESERVED = ("x", "severity", "rng", "mask", "v", "volumes", "seed")


@dataclass(frozen=True)
class Operator:
    name: str
    kind: str
    dims: str
    severity: tuple[float, float]
    lowering: str
    function: Callable
    pool: bool = False
    train: tuple[float, float] | None = None
    label_preserving: bool = True
    has_detector: bool = False
    identity_at_zero: bool = True
    modalities: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)


OPERATORS: dict[str, Operator] = {}


def operator(name: str, kind: str, dims: str, severity: tuple[float, float], *, lowering: str = "kernel", **more):
    """Register a function; its keyword parameters beyond the reserved ones become the operator's."""
    if kind not in KINDS or dims not in DIMS or lowering not in ("column", "kernel", "job"):
        raise ValueError(f"{name}: unknown kind, dims or lowering")
    if severity[0] > severity[1]:
        raise ValueError(f"{name}: severity range is inverted")

    def put(function: Callable) -> Callable:
        if name in OPERATORS:
            raise ValueError(f"{name} is registered already")
        own = {k: p.default for k, p in inspect.signature(function).parameters.items() if k not in RESERVED}
        OPERATORS[name] = Operator(name, kind, dims, severity, lowering, function, parameters=own, **more)
        return function

    return put


def get(name: str) -> Operator:
    if name not in OPERATORS:
        raise KeyError(f"no operator {name!r}")
    return OPERATORS[name]


@dataclass(frozen=True)
class ColumnVolume:
    """A volume as Columns: voxels and mask arrays and shape, with index arithmetic and keyed draws."""

    voxels: Column
    mask: Column
    shape: Column
    case: Column
    seed: int
    name: str

    def size(self, axis: int) -> Column:
        return F.get(self.shape, axis)

    def ijk(self, idx: Column) -> tuple[Column, Column, Column]:
        """The place of an index in C order."""
        nj, nk = self.size(1), self.size(2)
        k = idx % nk
        j = F.floor(idx / nk).cast("int") % nj
        return F.floor(idx / (nj * nk)).cast("int"), j, k

    def at(self, i: Column, j: Column, k: Column) -> Column:
        """The voxel at a place, which must be inside."""
        return F.get(self.voxels, ((i * self.size(1) + j) * self.size(2) + k).cast("int"))

    def map(self, function: Callable[[Column, Column, Column, Column], Column]) -> Column:
        """function(value, i, j, k) of every voxel."""
        return F.transform(self.voxels, lambda x, idx: function(x, *self.ijk(idx)))

    def map_masked(self, function: Callable[[Column, Column, Column], Column]) -> Column:
        """function(value, mask, index) of every voxel."""
        pairs = F.arrays_zip(self.voxels.alias("x"), self.mask.alias("m"))
        return F.transform(pairs, lambda p, idx: function(p["x"], p["m"], idx))

    def rolled(self, axis: int, by: Column) -> Column:
        """The voxels rolled by `by` along an axis, around the edge."""

        def one(_: Column, i: Column, j: Column, k: Column) -> Column:
            place = [i, j, k]
            place[axis] = F.pmod(place[axis] - by, self.size(axis)).cast("int")
            return self.at(*place)

        return self.map(one)

    def uniform(self, *draw) -> Column:
        return draws.uniform(F.lit(self.seed), self.case, self.name, *draw)

    def normal(self, *draw) -> Column:
        return draws.normal(F.lit(self.seed), self.case, self.name, *draw)

    def between(self, low: float, high: float, *draw) -> Column:
        return low + (high - low) * self.uniform(*draw)


def case_rng(seed: int, case: str, name: str) -> np.random.Generator:
    digest = hashlib.sha256(f"{seed}:{case}:{name}".encode()).digest()
    return np.random.Generator(np.random.Philox(int.from_bytes(digest[:16], "little")))


def run_kernel(op: Operator, x: np.ndarray, severity: float, rng: np.random.Generator, mask: np.ndarray | None, **params) -> np.ndarray:
    """One volume through a kernel: shape kept, input untouched, severity 0 an exact copy where the operator says so."""
    if op.identity_at_zero and severity <= 0:
        return x.copy()
    out = np.asarray(op.function(x.copy(), severity=severity, rng=rng, mask=mask, **params), np.float64)
    if out.shape != x.shape:
        raise ValueError(f"{op.name} changed the shape {x.shape} to {out.shape}")
    return out


def apply_operator(df: DataFrame, name: str, severity: float, seed: int = 0, case: str = "case_id", voxels: str = "voxels", mask: str | None = "mask", shape: str = "shape", **params) -> DataFrame:
    """The rows with `voxels` replaced; all other columns as they were.

    Severity is not clamped. Null voxels stay null. An unknown parameter raises.
    """
    op = get(name)
    if unknown := set(params) - set(op.parameters):
        raise TypeError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    values = F.col(voxels).cast("array<double>")
    inside = F.transform(F.col(mask), lambda m: m.cast("boolean")) if mask and mask in df.columns else F.transform(values, lambda x: x > 0)
    if op.lowering == "column":
        if op.identity_at_zero and severity <= 0:
            return df.withColumn(voxels, values)
        return df.withColumn(voxels, _column(op, values, inside, F.col(shape), F.col(case).cast("string"), severity, seed, params))

    if op.lowering == "job":
        if op.identity_at_zero and severity <= 0:
            return df.withColumn(voxels, values)
        return _job(op, df.withColumn(voxels, values), severity, seed, params, case, voxels, shape)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        masks = pdf[mask] if mask and mask in pdf else [None] * len(pdf)
        out = []
        for c, x, m, s in zip(pdf[case], pdf[voxels], masks, pdf[shape], strict=True):
            m = m if m is not None or x is None else np.asarray(x, float) > 0
            out.append(_one(name, severity, seed, params, None if pd.isna(c) else _text(c), x, m, s))
        return pdf.assign(**{voxels: out})

    return with_pandas(df.withColumn(voxels, values), run, changed=(voxels,))


def _text(case) -> str:
    """An id as Spark writes it; whole numbers that pandas holds as floats, beside nulls, are whole."""
    return str(int(case)) if isinstance(case, float) and case == int(case) else str(case)


def _column(op: Operator, voxels: Column, mask: Column, shape: Column, case: Column, severity: float, seed: int, params: dict) -> Column:
    """The operator on bound values, so that its many references don't repeat what computes them."""
    return A.let(lambda v, m, s, c: op.function(ColumnVolume(v, m, s, c, seed, op.name), severity=severity, **params), voxels, mask, shape, case)


def _job(op: Operator, df: DataFrame, severity: float | Column, seed: int, params: dict, case: str, voxels: str, shape: str) -> DataFrame:
    """The rows, numbered and staged, with the voxels that the operator's job gives for their numbers; null voxels or cases stay as they are."""
    rows = stage(df.withColumn("_uid", F.monotonically_increasing_id()), op.name)
    volumes = rows.filter(F.col(voxels).isNotNull() & F.col(case).isNotNull()).select("_uid", F.col(case).cast("string").alias("case_id"), F.col(voxels).alias("voxels"), F.col(shape).alias("shape"))
    made = op.function(volumes, severity=severity, seed=seed, **params).select("_uid", F.col("voxels").alias("_new"))
    return rows.join(made, "_uid", "left").withColumn(voxels, F.coalesce("_new", voxels)).drop("_uid", "_new")


def _one(name: str, severity: float, seed: int, params: dict, case, voxels, mask, shape):
    import voxframe.operators  # noqa: F401  (registers the kernels in the worker)

    if voxels is None or case is None:
        return voxels
    dims = tuple(int(k) for k in shape)
    x, inner = np.asarray(voxels, np.float64).reshape(dims), np.asarray(mask, bool).reshape(dims)
    return run_kernel(get(name), x, severity, case_rng(seed, case, name), inner, **params).ravel()


#: Rows and bytes of a batch that pandas gets at a time, one row at least: as Python's objects they take several times that.
PART = (512, 1 << 22)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices within PART, without a copy."""
    step = max(1, min(PART[0], PART[1] * batch.num_rows // max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def by_shape(voxels, masks, shapes) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """The rows of each shape, as their places and stacks of scans (float) and masks, so that NumPy takes a part of a batch at a time."""
    places: dict[tuple[int, ...], list[int]] = {}
    for k, s in enumerate(shapes):
        places.setdefault(tuple(int(n) for n in s), []).append(k)
    voxels, masks = list(voxels), list(masks)
    for dims, rows in places.items():
        yield rows, *(np.stack([np.asarray(a[k], kind).reshape(dims) for k in rows]) for a, kind in ((voxels, float), (masks, bool)))


def with_pandas(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], added: str = "", changed: tuple[str, ...] = ("voxels", "mask")) -> DataFrame:
    """The rows through a function of pandas frames, a part of a batch at a time (PART), that writes the columns `changed` and adds `added`.

    All other columns pass as they are, in Arrow, so no value of theirs is touched.
    A step of its own in the plan, which Spark can't move into an expression.
    """
    more = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(added)] if added else []
    schema = StructType([*df.schema.fields, *(StructType.fromDDL(added).fields if added else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            out = function(batch.to_pandas())
            arrays = [pa.array(out[f.name].tolist(), f.type) if f.name in changed else batch.column(k) for k, f in enumerate(batch.schema)]
            arrays += [pa.array(out[name].tolist(), kind) for name, kind in more]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *(name for name, _ in more)])

    return df.mapInArrow(run, schema)


def apply_chosen(df: DataFrame, chosen: Column, severity: dict[str, float | tuple[float, float]], seed: int = 0, errors: str | None = None) -> DataFrame:
    """Applies to each row the operator that `chosen` names; rows with null stay as they are.

    A severity is a number, or a range within which a kernel's is drawn for each
    case; a column operator and a job take the middle of it. The rows are staged,
    so that what made them runs once; those of kernels go through Python, those of
    each job through it, and the others through neither. A kernel's error is an error of the query, or is
    written to the column `errors` of a row that stays as it was: no row is left
    as it was while it is said to have been changed.
    """
    rows = stage(df.withColumn("_op", chosen).withColumn("voxels", F.col("voxels").cast("array<double>")), "chosen")
    bounds = {n: s if isinstance(s, tuple) else (s, s) for n, s in severity.items()}
    kernels = [n for n in bounds if get(n).lowering == "kernel"]
    case, inside = F.col("case_id").cast("string"), F.transform("mask", lambda m: m.cast("boolean"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, failed = [], list(pdf[errors]) if errors else []
        for k, (c, n, voxels, mask, shape) in enumerate(zip(pdf["case_id"].astype(str), pdf["_op"], pdf["voxels"], pdf["mask"], pdf["shape"], strict=True)):
            low, high = bounds[n]
            s = low if low == high else float(case_rng(seed, c, f"{n}:severity").uniform(low, high))
            try:
                out.append(_one(n, s, seed, {}, c, voxels, mask, shape))
            except Exception as e:
                if errors is None:
                    raise
                out.append(voxels)
                failed[k] = failed[k] or f"{n}: {e}"
        return pdf.assign(voxels=out, **({errors: failed} if errors else {}))

    out = None
    for n, (low, high) in bounds.items():
        if get(n).lowering == "column":
            own = _column(get(n), F.col("voxels"), inside, F.col("shape"), case, (low + high) / 2, seed, {})
            out = F.when(F.col("_op") == n, own) if out is None else out.when(F.col("_op") == n, own)
    jobs = [n for n in bounds if get(n).lowering == "job"]
    by = lambda names: F.coalesce(F.col("_op").isin(*names), F.lit(False))
    others = rows.filter(~by([*kernels, *jobs])) if kernels or jobs else rows
    others = others if out is None else others.withColumn("voxels", out.otherwise(F.col("voxels")))
    if kernels:
        others = others.unionByName(with_pandas(rows.filter(by(kernels)), run, changed=("voxels", *([errors] if errors else []))))
    for n in jobs:
        others = others.unionByName(_job(get(n), rows.filter(by([n])), sum(bounds[n]) / 2, seed, {}, "case_id", "voxels", "shape"))
    return others.drop("_op")


def chain(df: DataFrame, steps: list[tuple], seed: int = 0, **columns) -> DataFrame:
    """Several operators in turn: (name, severity) or (name, severity, parameters)."""
    for k, (name, severity, *rest) in enumerate(steps):
        df = apply_operator(df, name, severity, seed + k, **columns, **(rest[0] if rest else {}))
    return df


def catalogue(spark: SparkSession) -> DataFrame:
    """operators(name, kind, dims, sev_lo, sev_hi, lowering, label_preserving, has_detector, in_pool, train_lo, train_hi, parameters)."""
    rows = [
        (o.name, o.kind, o.dims, *map(float, o.severity), o.lowering, o.label_preserving, o.has_detector, o.pool, *(map(float, o.train or ((0.3, 0.85) if o.pool else (None, None))) if o.train or o.pool else (None, None)), sorted(o.parameters))
        for o in OPERATORS.values()
    ]
    schema = "name string, kind string, dims string, sev_lo double, sev_hi double, lowering string, label_preserving boolean, has_detector boolean, in_pool boolean, train_lo double, train_hi double, parameters array<string>"
    return spark.createDataFrame(rows, schema)
