"""The benchmark's middle: trials rendered from a plan, their status and retries, and what a run reports.

A condition is rendered for all cases at once, one query each, so that column
operators stay Columns and only kernels go through Python. A trial's draws depend
on seed, case, condition and repeat alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import draws
from ..functions.staging import stage
from ..operators import anatomy, stages
from ..operators import primitives as P
from ..operators.registry import OPERATORS, apply_operator, by_shape, case_rng, run_kernel, with_pandas
from .catalogue import PROTOCOL_OPERATORS, SEQUENCES, severity_for, specs

#: Draws of a full mix before a trial counts as failed.
FULL_MIX_ATTEMPTS = 6


def _attempts(render, retries: int):
    """(result, error, attempts): render() again after an exception, `retries` times at most; a result is never drawn again."""
    errors = []
    for attempt in range(1, retries + 2):
        try:
            return render(), None, attempt
        except Exception as e:  # noqa: BLE001  (whatever a renderer raises is that trial's outcome, and is reported)
            errors.append(f"{type(e).__name__}: {e}")
    return None, errors[-1], retries + 1


def _rendered(df: DataFrame, many, retries: int) -> DataFrame:
    """Rows with `voxels` and `mask` from many(cases, xs, masks), pairs for the rows of a shape; adds `error` and `attempts`.

    Where it raises, each row is rendered by itself, so that an error is that of its own row alone.
    """

    def outcomes(cases: list[str], xs: np.ndarray, masks: np.ndarray) -> list[tuple]:
        try:
            return [(got, None, 1) for got in many(cases, xs, masks)]
        except Exception:  # noqa: BLE001  (some row raised: which one, its own attempts tell)
            return [_attempts(lambda k=k: many([cases[k]], xs[k : k + 1], masks[k : k + 1])[0], retries) for k in range(len(cases))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, cases = [None] * len(pdf), [str(case) for case in pdf["case_id"]]
        for rows, xs, masks in by_shape(pdf["voxels"], pdf["mask"], pdf["shape"]):
            for k, x, m, (got, error, attempts) in zip(rows, xs, masks, outcomes([cases[k] for k in rows], xs, masks), strict=True):
                y, n = got if got is not None else (x, m)
                if error is None and (y.shape != x.shape or n.shape != x.shape):
                    y, n, error = x, m, "the grid changed"
                out[k] = (y.ravel(), n.ravel(), error, attempts)
        return pdf.assign(**{k: [o[i] for o in out] for i, k in enumerate(("voxels", "mask", "error", "attempts"))})

    return with_pandas(df, run, "error string, attempts int")


def _each(one):
    """many() of a renderer of single rows: one(case, x, mask)."""
    return lambda cases, xs, masks: [one(*row) for row in zip(cases, xs, masks, strict=True)]


def _mild(name: str, seed: int, repeat: int):
    def many(cases: list[str], xs: np.ndarray, masks: np.ndarray):
        rngs, shape = [case_rng(seed, f"{case}:{repeat}", name) for case in cases], xs.shape[1:]
        if name in ("rotation", "resize", "mild_mix"):
            turns = [rng.uniform(-10, 10, 3) if name != "resize" else (0.0, 0.0, 0.0) for rng in rngs]
            xs, masks = anatomy.poses(xs, masks, [{"degrees": d, "scale": rng.uniform(0.9, 1.1) if name != "rotation" else 1.0} for d, rng in zip(turns, rngs, strict=True)])
        if name in ("resolution", "mild_mix"):
            small = [[max(1, round(n / rng.uniform(1.0, 2.0))) for n in shape] for rng in rngs]
            xs = [P.resize(P.resize(x, s), shape) for x, s in zip(xs, small, strict=True)]
        return list(zip(xs, masks, strict=True))

    return many


def _composite(name: str, seed: int, repeat: int):
    def many(cases: list[str], xs: np.ndarray, masks: np.ndarray):
        rngs = [case_rng(seed, f"{case}:{repeat}", name) for case in cases]
        if name == "morphology":
            made = anatomy.morphs(xs, masks, rngs, [rng.uniform(0.2, 0.45) for rng in rngs])[:2]
        else:
            made = anatomy.syntheses(xs, masks, rngs)
        return list(zip(*made, strict=True))

    return many


def full_mix_choice(seed: int, case: Column, attempts: int = FULL_MIX_ATTEMPTS) -> Column:
    """struct(artifacts, attempts, rejected) of a case: the first of up to six draws with two artifacts; null artifacts if none has.

    Each draw is one or two distinct pool operators, one strong dimmer at most.
    """
    pool = F.array(*[F.lit(n) for n, o in OPERATORS.items() if o.pool])
    first = None
    for k in range(attempts):
        good = draws.uniform(seed, case, "mix", k, "count") >= 0.5
        first = F.when(good, k) if first is None else first.when(good, k)

    def chosen(k: Column) -> Column:
        """Only the draw that is taken ranks the pool."""
        artifacts = F.when(k.isNotNull(), stages.two_of_pool(pool, lambda n: draws.uniform(seed, case, "mix", k, n)))
        return F.struct(artifacts.alias("artifacts"), F.coalesce(k + 1, F.lit(attempts)).alias("attempts"), F.coalesce(k, F.lit(attempts)).alias("rejected"))

    return A.let(chosen, first)


def trial_severity(name: str, seed: int, repeat: int) -> float:
    """Within the condition's range, by seed, condition and repeat: the same for all cases."""
    low, high = (1.0, 1.0) if name in PROTOCOL_OPERATORS else severity_for(name)
    return low + (high - low) * float(case_rng(seed, str(repeat), name).random())


def render(cases: DataFrame, name: str, repeat: int = 0, seed: int = 0, retries: int = 2) -> DataFrame:
    """Every case (case_id, voxels, mask, shape) under one condition of the catalogue, and the trial's outcome: condition, repeat,
    severity, attempts, error, changed_voxels, target_changed and status.

    `failed`: the renderer raised each time, gave another grid, values that aren't
    finite or an empty mask; voxels and mask are then those of the case.
    `unchanged`: nothing but `clean` may leave all voxels as they were. A case
    with a null or empty mask fails. An empty table gives no rows; other columns stay.
    """
    kinds = {s[0]: s[2] for s in specs()}
    if name not in kinds:
        raise ValueError(f"unknown condition {name!r}")
    kind, severity = kinds[name], None
    own = F.transform(F.col("voxels"), lambda x: x.cast("double"))
    rows = cases.withColumns({"voxels": own, "mask": F.transform("mask", lambda m: m.cast("boolean"))})
    rows = rows.withColumns({"_source": F.col("voxels"), "_target": F.col("mask")})
    plain = lambda df: df.withColumns({"error": F.lit(None).cast("string"), "attempts": F.lit(1)})
    if kind == "clean":
        out = plain(rows)
    elif kind == "spatial":
        out = _rendered(rows, _mild(name, seed, repeat), retries)
    elif kind == "sequence" and name in SEQUENCES:
        out = plain(stages.render_sequence(rows, F.lit(name), seed=seed + repeat))
    elif kind == "operator":
        severity = trial_severity(name, seed, repeat)
        op = OPERATORS[name]
        if op.lowering != "kernel":
            out = plain(apply_operator(rows, name, severity, seed + repeat))
        else:
            out = _rendered(rows, _each(lambda case, x, m: (run_kernel(OPERATORS[name], x, severity, case_rng(seed + repeat, case, name), m), m)), retries)
    elif name == "realistic_appearance":
        out = plain(stages.appearance(rows, seed + repeat))
    elif name == "full_mix":
        out = plain(rows).withColumn("_mix", full_mix_choice(seed + repeat, F.col("case_id").cast("string")))
        out = out.withColumn("error", F.when(F.col("_mix.artifacts").isNull(), "no draw has two artifacts"))
        for turn in range(2):
            out = stages.apply_pool(out, F.get(F.col("_mix.artifacts"), turn), seed + repeat + turn, errors="error")
        out = out.drop("_mix")
    else:
        out = _rendered(rows, _composite(name, seed, repeat), retries)
    finite = F.forall("voxels", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    error = F.coalesce(F.col("error"), F.when(F.size("voxels") != F.size("_source"), "the grid changed").when(~finite, "values that aren't finite").when(~F.coalesce(F.exists("mask", lambda m: m), F.lit(False)), "an empty mask"))
    out = out.withColumn("error", error)
    for now, was in (("voxels", "_source"), ("mask", "_target")):
        out = out.withColumn(now, F.when(F.col("error").isNull(), F.col(now)).otherwise(F.col(was)))
    changed = F.size(F.filter(F.zip_with("voxels", "_source", lambda a, b: a != b), lambda t: t))
    status = F.when(F.col("error").isNotNull(), "failed").when((F.lit(name) != "clean") & (F.col("changed_voxels") == 0), "unchanged").otherwise("ok")
    done = out.withColumns({"condition": F.lit(name), "repeat": F.lit(repeat), "severity": F.lit(severity).cast("double"), "changed_voxels": changed, "target_changed": F.col("mask") != F.col("_target")})
    return done.withColumn("status", status).drop("_source", "_target")


def render_plan(cases: DataFrame, conditions: list[str], repeats: int = 1, seed: int = 0, retries: int = 2) -> DataFrame:
    """Each condition for all cases, `repeats` times (`clean` once), as one table; a run of many conditions writes each by itself.

    Cases are staged where they are read more than once, so that what made them runs once.
    """
    if len(conditions) > 1 or repeats > 1:
        cases = stage(cases, "cases")
    out = None
    for name in conditions:
        for repeat in range(1 if name == "clean" else repeats):
            part = render(cases, name, repeat, seed, retries)
            out = part if out is None else out.unionByName(part)
    return out


def timing_rollup(trials: DataFrame, *by: str) -> DataFrame:
    """Sums of the seconds spent on rendering, prediction and in all, and the trials."""
    return trials.groupBy(*by).agg(F.count(F.lit(1)).alias("trials"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("render_seconds", "predict_seconds", "total_seconds")])


def batch_report(rows: DataFrame, *by: str) -> DataFrame:
    """succeeded, failed, skipped and review, the counts of a directory run's outcomes, and the first failed output; rows(output, outcome, review)."""
    of = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    return rows.groupBy(*by).agg(of("succeeded"), of("failed"), of("skipped"), F.count_if(F.col("review")).alias("review"), F.min(F.when(F.col("outcome") == "failed", F.col("output"))).alias("first_failed"))


def batch_sizes(trials: DataFrame, run: list[str], order: list[str], first: int, failed: str = "oom") -> DataFrame:
    """The batch size of each trial: it halves, down to 1, after each out-of-memory failure and stays so for later trials of the run."""
    keys, by = ", ".join(f"`{c}`" for c in run), ", ".join(f"`{c}`" for c in order)
    before = f"coalesce(count_if(`{failed}`) OVER (PARTITION BY {keys} ORDER BY {by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return trials.withColumn("batch_size", F.greatest(F.lit(1), F.floor(F.lit(first) / F.pow(F.lit(2.0), F.least(F.expr(before), F.lit(30)))).cast("int")))


def refresh_points(records: DataFrame, run: list[str], time: str, seconds: int) -> DataFrame:
    """The records at which a run's report is written anew: the first and the last, and the first of each span of `seconds` since the run began."""
    keys = ", ".join(f"`{c}`" for c in run)
    span = f"floor((unix_micros(CAST(`{time}` AS TIMESTAMP)) - min(unix_micros(CAST(`{time}` AS TIMESTAMP))) OVER (PARTITION BY {keys})) / {seconds * 10**6})"
    spans = records.withColumn("span", F.expr(span).cast("long"))
    ends = spans.groupBy(*run).agg(F.max(time).alias("_last"))
    firsts = spans.groupBy(*run, "span").agg(F.min(time).alias(time))
    return firsts.select(*run, time).union(ends.select(*run, F.col("_last").alias(time))).distinct()


def reference_policy(original: Column, current: Column) -> Column:
    """`keep` only if both reports know their reference policy and it is the same; else `refuse`."""
    return F.when(original.isNotNull() & (original == current), "keep").otherwise("refuse")
