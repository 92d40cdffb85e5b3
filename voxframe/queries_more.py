"""Further queries on the driver's tables: surfaces, windows, anatomy, acquisition draws and the benchmark's trials."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scores as S
from .functions.tasks import spread
from .operators import OPERATORS, anatomy, sampling, stages
from .operators import measures as M
from .operators.registry import ColumnVolume
from .plans import acquisition, routing, trials
from .queries import _NORMAL, _VOX, SEED, _at, _choice_sql, _u, _vectors, query, r6, rounded, table
from .sources import exports
from .sources.volumes import embedding_volumes

Q = "'{}'".format


def _columns(name: str, seed: int = SEED) -> ColumnVolume:
    return ColumnVolume(F.col("voxels"), F.col("mask"), F.col("shape"), F.col("case_id").cast("string"), seed, name)


def _long(df: DataFrame, values: str = "voxels") -> DataFrame:
    """vec_id, idx and value of every voxel."""
    out = df.select(F.col("case_id").alias("vec_id"), F.posexplode(values).alias("idx", "value"))
    return out.select("vec_id", "idx", r6(F.col("value").cast("double")).alias("value"))


# surfaces

_PAIRS = "pairs AS (SELECT p.vec_id, p.idx, p.x, p.m, q.m AS o, (p.a-q.a)*(p.a-q.a)+(p.b-q.b)*(p.b-q.b)+(p.c-q.c)*(p.c-q.c) AS r2, greatest(abs(p.a-q.a), abs(p.b-q.b), abs(p.c-q.c)) AS reach FROM vox p JOIN vox q USING (vec_id))"
_SURFACE = f"""{_VOX}, {_PAIRS},
surface AS (
  SELECT vec_id, idx, any_value(x) AS x, any_value(m) AS m, coalesce(sqrt(min(r2) FILTER (NOT o)), 0.0) AS inner_d, coalesce(sqrt(min(r2) FILTER (o)), 0.0) AS outer_d,
    bool_or(o AND reach <= 2) AND bool_or(NOT o AND reach <= 2) AS band FROM pairs GROUP BY vec_id, idx),
signed AS (SELECT s.*, CASE WHEN g.n = 0 OR g.n = 64 THEN 0.0 ELSE outer_d - inner_d END AS distance FROM surface s JOIN (SELECT vec_id, count(*) FILTER (m) AS n FROM vox GROUP BY vec_id) g USING (vec_id))"""


@query("signed_distance", f"WITH {_SURFACE} SELECT vec_id, idx::INTEGER AS idx, round(distance, 6) + 0.0 AS distance, round(inner_d, 6) + 0.0 AS inside, round(outer_d, 6) + 0.0 AS outside, band FROM signed")
def _distances(spark: SparkSession, sf: str) -> DataFrame:
    rows = anatomy.surfaces(embedding_volumes(spark, sf))
    zipped = F.arrays_zip("distance", "inside", "outside", "band")
    out = rows.select(F.col("case_id").alias("vec_id"), F.posexplode(zipped).alias("idx", "s")).select("vec_id", "idx", "s.*")
    return rounded(out, "distance", "inside", "outside")


_Z = "((x - 0.5) * 6)"
_SIG = f"(1 / (1 + exp(-{_Z})))"
_T = "m::INTEGER"


@query(
    "surface_losses",
    f"""WITH {_SURFACE}, f AS (SELECT *, {_SIG} AS p, (1 - {_T}) * {_Z} + (1 + 1.5 * {_T}) * (ln(1 + exp(-abs({_Z}))) + greatest(-{_Z}, 0.0)) AS ce FROM signed),
    l AS (SELECT vec_id, avg(p * distance) AS boundary, coalesce(avg(power(greatest(1 - (CASE WHEN m THEN p ELSE 1 - p END), 0.0), 2) * ce) FILTER (band), 0.0) AS focal,
      avg(CASE WHEN abs(distance) >= 1.5 THEN 0.1 ELSE 1.0 END * power({_Z} - least(greatest(-distance, -1.5), 1.5), 2)) AS clipped FROM f GROUP BY vec_id)
    SELECT vec_id, round(boundary, 6) + 0.0 AS boundary, round(focal, 6) + 0.0 AS focal, round(clipped, 6) + 0.0 AS clipped, round((boundary + 0.5 * focal + 0.25 * clipped) / 1.75, 6) + 0.0 AS supervised FROM l""",
)
def _surface_losses(spark: SparkSession, sf: str) -> DataFrame:
    rows = anatomy.surfaces(embedding_volumes(spark, sf))
    z = F.transform("voxels", lambda x: (x - 0.5) * 6)
    losses = {"boundary": S.boundary_loss(z, F.col("distance")), "focal": S.boundary_focal_loss(z, F.col("mask"), F.col("band")), "clipped": S.clipped_distance_loss(z, F.transform("distance", lambda d: -d), 1.5)}
    out = rows.select(F.col("case_id").alias("vec_id"), *[x.alias(k) for k, x in losses.items()])
    return rounded(out.withColumn("supervised", S.deep_supervision([F.col(k) for k in losses])), *losses, "supervised")


@query(
    "posterior_dice",
    f"""WITH {_VOX}, box AS (SELECT vec_id, count(*) AS n, min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(c) AS c0, max(c) AS c1 FROM vox WHERE m GROUP BY vec_id),
    j AS (SELECT vox.vec_id, x > 0.4 AS p, m, coalesce(a >= a0 - 1 AND a < a1 + 2 AND b >= b0 - 1 AND b < b0 + ceil(0.5 * (b1 + 1 - b0)) + 1 AND c >= c0 - 1 AND c < c0 + ceil(0.42 * (c1 + 1 - c0)) + 1, true) AS i FROM vox LEFT JOIN box USING (vec_id))
    SELECT vec_id, round((2.0 * count(*) FILTER (p AND m AND i) + 1e-6) / (count(*) FILTER (p AND i) + count(*) FILTER (m AND i) + 1e-6), 6) + 0.0 AS dice FROM j GROUP BY vec_id""",
)
def _posterior(spark: SparkSession, sf: str) -> DataFrame:
    rows = embedding_volumes(spark, sf)
    v = _columns("posterior")
    rows = rows.withColumn("box", M.bounding_box(v)).withColumn("inside", sampling.posterior_box(v, F.col("box"), 1))
    dice = S.regional_dice(F.transform("voxels", lambda x: x > 0.4), F.col("mask"), F.col("inside"))
    return rows.select(F.col("case_id").alias("vec_id"), r6(dice).alias("dice"))


# windows

_SIZE = (2, 3, 6)
_PAD = (0, 0, 1)
_SPANS = (4, 4, 6)


def _d(name: str, *parts: str) -> str:
    return _u(Q(SEED), "vec_id", Q(name), *parts)


def _window_sql(lows: list[str]) -> str:
    n = math.prod(_SIZE)
    places = ("i // 18", "(i // 6) % 3", "i % 6")
    inside = " AND ".join(f"{p} + l{k} BETWEEN 0 AND 3" for k, p in enumerate(places))
    value = f"CASE WHEN {inside} THEN v[1 + 16 * ({places[0]} + l0) + 4 * ({places[1]} + l1) + ({places[2]} + l2)] ELSE 0.0 END"
    return f"lows AS (SELECT vec_id, {', '.join(f'({low})::INTEGER AS l{k}' for k, low in enumerate(lows))} FROM anchored) SELECT vec_id, i::INTEGER AS idx, round({value}, 6) + 0.0 AS value FROM vol JOIN lows USING (vec_id), range(0, {n}) r(i)"


def _anywhere(name: str, k: int) -> str:
    return f"floor({_d(name, Q('crop'), Q(k))} * {_SPANS[k] - _SIZE[k] + 1}) - {_PAD[k]}"


def _around(name: str, k: int) -> str:
    at = f"({('anchor // 16', '(anchor // 4) % 4', 'anchor % 4')[k]} + {_PAD[k]})"
    low, high = f"greatest(0, {at} - {_SIZE[k] - 1})", f"least({at}, {_SPANS[k] - _SIZE[k]})"
    return f"CASE WHEN {high} > {low} THEN {low} + floor({_d(name, Q('crop'), Q(k))} * ({high} - {low} + 1)) ELSE {low} END - {_PAD[k]}"


def _either(name: str) -> list[str]:
    return [f"CASE WHEN anchor IS NULL THEN {_anywhere(name, k)} ELSE {_around(name, k)} END" for k in range(3)]


def _crop(name: str, lows, surfaces: bool = False):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = embedding_volumes(spark, sf)
        if surfaces:
            rows = anatomy.surfaces(rows, spacing=(4.0, 4.0, 4.0))
        v = _columns(name)
        return _long(rows.withColumn("voxels", sampling.window(v, lows(v), _SIZE)))

    return run


query("crop_uniform", f"WITH {_NORMAL}, anchored AS (SELECT vec_id FROM vol), {_window_sql([_anywhere('crop_uniform', k) for k in range(3)])}")(_crop("crop_uniform", lambda v: sampling.uniform_low(v, _SIZE)))
query(
    "crop_foreground",
    f"""WITH {_VOX}, pool AS (SELECT vec_id, list(idx ORDER BY idx) AS pool FROM vox WHERE m GROUP BY vec_id),
    anchored AS (SELECT vec_id, CASE WHEN {_d('crop_foreground', Q('foreground'))} < 0.6 THEN pool[1 + floor({_d('crop_foreground', Q('anchor'))} * len(pool))::INTEGER] END AS anchor FROM vol LEFT JOIN pool USING (vec_id)), {_window_sql(_either('crop_foreground'))}""",
)(_crop("crop_foreground", lambda v: sampling.foreground_low(v, _SIZE, 0.6)))
_KIND = _d("crop_boundary", Q("kind"))
query(
    "crop_boundary",
    f"""WITH {_SURFACE}, mm AS (SELECT vec_id, idx, m, 4 * inner_d AS i, 4 * outer_d AS o, bool_or(4 * inner_d > 15) OVER (PARTITION BY vec_id) AS deep, bool_or(m) OVER (PARTITION BY vec_id) AS has, {_KIND} AS u FROM signed),
    pool AS (SELECT vec_id, list(idx ORDER BY idx) AS pool FROM mm WHERE has AND CASE WHEN u < 0.1 THEN false WHEN u < 0.6 THEN i BETWEEN 5 AND 15 OR o BETWEEN 5 AND 15 WHEN u < 0.8 THEN CASE WHEN deep THEN i > 15 ELSE i > 0 END ELSE o BETWEEN 2 AND 20 END GROUP BY vec_id),
    anchored AS (SELECT vec_id, pool[1 + floor({_d('crop_boundary', Q('anchor'))} * len(pool))::INTEGER] AS anchor FROM vol LEFT JOIN pool USING (vec_id)), {_window_sql(_either('crop_boundary'))}""",
)(_crop("crop_boundary", lambda v: sampling.boundary_low(v, _SIZE, F.col("inside"), F.col("outside")), True))

_RN = "norm_region"
_MOVE = [f"round_even(-4.0 + 8.0 * {_d(_RN, Q('move'), Q(k))}, 0)" for k in range(3)]


@query(
    "normalisation_region",
    f"""WITH {_SURFACE}, u AS (SELECT vec_id, {_d(_RN, Q('region'))} AS u, {_d(_RN, Q('how'))} AS how, 1.0 + 3.0 * {_d(_RN, Q('mm'))} AS mm, {', '.join(f'({x})::INTEGER AS s{k}' for k, x in enumerate(_MOVE))} FROM vol),
    g AS (SELECT s.*, u.*, idx // 16 AS a, (idx // 4) % 4 AS b, idx % 4 AS c FROM signed s JOIN u USING (vec_id)),
    r AS (SELECT g.vec_id, g.idx, g.m, g.u, CASE WHEN how < 0.4 THEN g.inner_d > mm WHEN how < 0.8 THEN g.m OR g.outer_d <= mm ELSE coalesce(w.m, false) END AS rough
      FROM g LEFT JOIN vox w ON w.vec_id = g.vec_id AND w.a = g.a - s0 AND w.b = g.b - s1 AND w.c = g.c - s2),
    t AS (SELECT vec_id, any_value(u) AS u, count(*) FILTER (m) AS n, count(*) FILTER (rough) AS rough FROM r GROUP BY vec_id)
    SELECT vec_id, CASE WHEN n = 0 OR u < 0.3 THEN 'foreground' ELSE 'region' END AS kind, CASE WHEN n = 0 OR u < 0.3 THEN NULL WHEN u < 0.5 OR rough = 0 THEN n ELSE rough END::INTEGER AS voxels FROM t""",
)
def _norm_region(spark: SparkSession, sf: str) -> DataFrame:
    rows = anatomy.surfaces(embedding_volumes(spark, sf))
    region = sampling.normalisation_region(_columns(_RN), F.col("inside"), F.col("outside"))
    out = rows.select(F.col("case_id").alias("vec_id"), region.alias("region"))
    return out.select("vec_id", F.when(F.col("region").isNull(), "foreground").otherwise("region").alias("kind"), F.when(F.col("region").isNotNull(), F.size(F.filter("region", lambda m: m))).alias("voxels"))


# anatomy

_NEAR = "list_transform(e, lambda x: CASE WHEN abs(x - c[1]) <= abs(x - c[2]) AND abs(x - c[1]) <= abs(x - c[3]) THEN 1 WHEN abs(x - c[2]) <= abs(x - c[3]) THEN 2 ELSE 3 END)"


@query(
    "kmeans_labels",
    f"""WITH RECURSIVE {_NORMAL}, inner_v AS (SELECT vec_id, list_filter(v, lambda x: x > med) AS e FROM vol),
    steps(vec_id, step, e, c) AS (
      SELECT vec_id, 0, e, list_value(list_aggregate(e, 'quantile_cont', 0.25), list_aggregate(e, 'quantile_cont', 0.5), list_aggregate(e, 'quantile_cont', 0.75)) FROM inner_v WHERE len(e) > 0
      UNION ALL
      SELECT vec_id, step + 1, e, list_transform(range(1, 4), lambda k: coalesce(list_avg(list_transform(list_filter(list_zip(e, l), lambda p: p[2] = k), lambda p: p[1])), c[k])) FROM (SELECT *, {_NEAR} AS l FROM steps WHERE step < 15))
    SELECT vec_id, len(list_filter(l, lambda k: k = o[1]))::INTEGER AS dark, len(list_filter(l, lambda k: k = o[2]))::INTEGER AS middle, len(list_filter(l, lambda k: k = o[3]))::INTEGER AS bright
    FROM (SELECT vec_id, {_NEAR} AS l, list_transform(list_sort(list_transform(range(1, 4), lambda k: {{'c': c[k], 'k': k}})), lambda s: s.k) AS o FROM steps WHERE step = 15)""",
)
def _kmeans(spark: SparkSession, sf: str) -> DataFrame:
    @F.pandas_udf("dark int, middle int, bright int")
    def counts(values: pd.Series) -> pd.DataFrame:
        found = [np.bincount(anatomy.ordered_kmeans(np.asarray(v, float)), minlength=3) for v in values]
        return pd.DataFrame([f.tolist() for f in found], columns=["dark", "middle", "bright"], dtype="int32")

    inside = F.transform(F.filter(F.arrays_zip("voxels", "mask"), lambda p: p["mask"]), lambda p: p["voxels"])
    return embedding_volumes(spark, sf).withColumn("v", inside).filter("size(v) > 0").select(F.col("case_id").alias("vec_id"), counts("v").alias("c")).select("vec_id", "c.*")


@query("stage_quarter_turn", f"WITH {_VOX} SELECT vec_id, idx::INTEGER AS idx, round({_at('b', '3 - a', 'c')}, 6) + 0.0 AS value FROM vox")
def _turn(spark: SparkSession, sf: str) -> DataFrame:
    return _long(anatomy.moved(embedding_volumes(spark, sf).withColumn("mask", F.transform("mask", lambda m, i: i % 64 == 21)), "pose", SEED, degrees=(0.0, 0.0, 90.0), scale=1.0))


for _kind in ("pose", "morph", "mp2rage_morphology", "label_synthesis"):

    def _stage(spark: SparkSession, sf: str, kind: str = _kind) -> DataFrame:
        out = anatomy.moved(embedding_volumes(spark, sf), kind, SEED)
        return out.select(F.col("case_id").alias("vec_id"), F.size("voxels").alias("voxels"), F.size(F.filter("mask", lambda m: m)).alias("masked"), "moved")

    query(f"stage_{_kind}")(_stage)


@query("stage_hard_tail")
def _hard(spark: SparkSession, sf: str) -> DataFrame:
    return stages.hard_tail(embedding_volumes(spark, sf), SEED).select(F.col("case_id").alias("vec_id"), "profile", "verdict")


# acquisition draws, curves

_AC = lambda name: _u("'3'", "c_custkey", Q(name))
_EVEN = lambda names: {str(n): 1.0 for n in names}


@query(
    "acquisition_draws",
    f"""WITH s AS (SELECT c_custkey, {_choice_sql(_AC('sequence'), _EVEN(acquisition.SEQUENCES))} AS sequence, {_choice_sql(_AC('vendor'), _EVEN(acquisition.VENDORS))} AS vendor, {_choice_sql(_AC('recon'), _EVEN(acquisition.RECONSTRUCTIONS))} AS recon,
    {_choice_sql(_AC('field'), acquisition.HIGH_FIELDS)} AS high, {_choice_sql(_AC('field'), _EVEN(acquisition.FIELDS))} AS low, {_choice_sql(_AC('style'), acquisition.SITE_STYLES)} AS style, {_AC('grain')} AS g FROM customer)
    SELECT c_custkey, CASE WHEN sequence = 'MP2RAGE' THEN high ELSE low END::DOUBLE AS field, sequence, vendor, recon, style, round(CASE WHEN style = 'grainy' THEN 0.25 + 0.75 * g ELSE 0.0 END, 6) + 0.0 AS strength FROM s""",
)
def _acquisitions(spark: SparkSession, sf: str) -> DataFrame:
    case = F.col("c_custkey").cast("string")
    out = table(spark, sf, "customer").select("c_custkey", acquisition.acquisition(3, case).alias("a"), acquisition.site_style(3, case).alias("s"))
    return rounded(out.select("c_custkey", "a.*", "s.*"), "strength")


@query("contrast_temperature", f"WITH {_VOX} SELECT vec_id, idx::INTEGER AS idx, round(1.0 / (1.0 + exp(-1.7 * ln(q / (1.0 - q)))), 6) + 0.0 AS value FROM (SELECT *, least(greatest(x, 1e-5), 1 - 1e-5) AS q FROM vox)")
def _temperature(spark: SparkSession, sf: str) -> DataFrame:
    return _long(embedding_volumes(spark, sf).withColumn("voxels", F.transform("voxels", lambda x: acquisition.contrast_temperature(x, 1.7))))


@query(
    "tied_knots",
    f"""WITH {_VOX}, k AS (SELECT vec_id, round_even(x * 8, 0) AS x, avg(y) AS y FROM (SELECT vec_id, x, {_at('3 - a')} AS y FROM vox) GROUP BY 1, 2)
    SELECT vec_id, round(x, 6) + 0.0 AS x, round(max(y) OVER (PARTITION BY vec_id ORDER BY x), 6) + 0.0 AS y FROM k""",
)
def _knots(spark: SparkSession, sf: str) -> DataFrame:
    v = _columns("knots")
    rows = embedding_volumes(spark, sf).withColumns({"x": F.transform("voxels", lambda x: F.bround(x * 8)), "y": v.map(lambda _, i, j, k: v.at(3 - i, j, k))})
    return rounded(rows.select(F.col("case_id").alias("vec_id"), F.explode(acquisition.tied_knots(F.col("x"), F.col("y"))).alias("k")).select("vec_id", "k.*"), "x", "y")


def _mix64(x: str) -> str:
    """SplitMix64 of an unsigned 64-bit value in SQL, without repeating its argument."""
    wrap = lambda e: f"(({e}) % 18446744073709551616::UHUGEINT)::UBIGINT"
    steps = [wrap("v::UHUGEINT + 11400714819323198485::UHUGEINT"), wrap("xor(v, v >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT"), wrap("xor(v, v >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT"), "xor(v, v >> 31)"]
    out = x
    for step in steps:
        out = f"list_transform([{out}], lambda v: {step})[1]"
    return out


@query(
    "batch_gate",
    f"""WITH a AS (SELECT event_id, {_mix64("xor(" + _mix64("5::UBIGINT") + ", " + _mix64("(user_id + 1)::UBIGINT") + ")")} AS h FROM events),
    b AS (SELECT a.event_id, {_mix64("xor(h, " + _mix64("(e.event_id + 2)::UBIGINT") + ")")} AS h FROM a JOIN events e USING (event_id))
    SELECT event_id, ({_mix64("xor(h, " + _mix64("(8 + 3)::UBIGINT") + ")")} >> 11)::DOUBLE / 9007199254740992.0 < 0.3 AS attacked FROM b""",
)
def _batch_gate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", F.lit(8).alias("size"))
    return routing.with_batch_gate(e, 5, "user_id", "event_id", "size", 0.3).select("event_id", "attacked")


# trials

_POOL = [n for n, o in OPERATORS.items() if o.pool]
_DIM = ", ".join(map(Q, routing.STRONG_DIMMERS))


@query(
    "full_mix_choice",
    f"""WITH t AS (SELECT c_custkey, k, n, row_number() OVER (PARTITION BY c_custkey, k ORDER BY {_u("'3'", "c_custkey", "'mix'", "k", "n")}, n) AS r FROM customer, range(0, 6) x(k), (SELECT unnest([{', '.join(map(Q, _POOL))}]) AS n)),
    f AS (SELECT c_custkey, k, any_value(n) FILTER (r = 1) AS one, any_value(n) FILTER (r = 2) AS two, arg_min(n, r) FILTER (r > 1 AND n NOT IN ({_DIM})) AS other FROM t GROUP BY ALL),
    g AS (SELECT * FROM f WHERE {_u("'3'", "c_custkey", "'mix'", "k", "'count'")} >= 0.5), m AS (SELECT c_custkey, min(k) AS k FROM g GROUP BY 1)
    SELECT c.c_custkey, CASE WHEN g.one IS NOT NULL THEN g.one || '+' || CASE WHEN g.one IN ({_DIM}) THEN g.other ELSE g.two END END AS artifacts, coalesce(m.k + 1, 6)::INTEGER AS attempts, coalesce(m.k, 6)::INTEGER AS rejected
    FROM customer c LEFT JOIN m USING (c_custkey) LEFT JOIN g ON g.c_custkey = m.c_custkey AND g.k = m.k""",
)
def _full_mix(spark: SparkSession, sf: str) -> DataFrame:
    out = spread(table(spark, sf, "customer").select("c_custkey")).select("c_custkey", trials.full_mix_choice(3, F.col("c_custkey").cast("string")).alias("m")).select("c_custkey", "m.*")
    return out.withColumn("artifacts", F.array_join("artifacts", "+"))


_CLIP = trials.trial_severity("clipping", SEED, 0)


@query(
    "rendered_trials",
    f"""WITH {_VOX}, cap AS (SELECT vec_id, quantile_cont(x, {(99.5 - 25.0 * _CLIP) / 100.0}) AS cap FROM vox WHERE m GROUP BY vec_id),
    c AS (SELECT vec_id, count(*) FILTER (least(x, cap) <> x) AS n, count(*) FILTER (m) AS target FROM vox LEFT JOIN cap USING (vec_id) GROUP BY vec_id)
    SELECT vec_id, condition, 0 AS repeat, severity, CASE WHEN target = 0 THEN 'failed' WHEN condition = 'clean' OR n > 0 THEN 'ok' ELSE 'unchanged' END AS status, CASE WHEN condition = 'clean' OR target = 0 THEN 0 ELSE n END::INTEGER AS changed_voxels
    FROM c, (VALUES ('clean', NULL), ('clipping', {round(_CLIP, 6)!r})) s(condition, severity)""",
)
def _rendered(spark: SparkSession, sf: str) -> DataFrame:
    out = trials.render_plan(embedding_volumes(spark, sf), ["clean", "clipping"], 1, SEED)
    return rounded(out.select(F.col("case_id").alias("vec_id"), "condition", "repeat", "severity", "status", "changed_voxels"), "severity")


@query("rendered_composites")
def _composites(spark: SparkSession, sf: str) -> DataFrame:
    """Conditions whose fields are drawn: their statuses; tests/test_trials.py holds their laws."""
    out = trials.render_plan(embedding_volumes(spark, sf), ["mild_mix", "gibbs", "morphology", "label_synthesis", "full_mix"], 1, SEED)
    return out.groupBy("condition", "status").agg(F.count(F.lit(1)).alias("trials"))


@query("timing_rollup", "SELECT event_type, count(*) AS trials, round(sum(value) FILTER (event_id % 3 = 0), 6) + 0.0 AS render_seconds, round(sum(value) FILTER (event_id % 3 = 1), 6) + 0.0 AS predict_seconds, round(sum(value), 6) + 0.0 AS total_seconds FROM events GROUP BY event_type")
def _timing(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("render_seconds"), F.when(F.col("event_id") % 3 == 1, F.col("value")).alias("predict_seconds"), F.col("value").alias("total_seconds"))
    return rounded(trials.timing_rollup(e, "event_type"), "render_seconds", "predict_seconds", "total_seconds")


@query("batch_report", "SELECT lang, count(*) FILTER (doc_id % 5 > 1) AS succeeded, count(*) FILTER (doc_id % 5 = 1) AS failed, count(*) FILTER (doc_id % 5 = 0) AS skipped, count(*) FILTER (n_chars > 5000) AS review, min(doc_id::VARCHAR) FILTER (doc_id % 5 = 1) AS first_failed FROM documents GROUP BY lang")
def _batch(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 5 == 1, "failed").when(F.col("doc_id") % 5 == 0, "skipped").otherwise("succeeded")
    d = table(spark, sf, "documents").select("lang", F.col("doc_id").cast("string").alias("output"), kind.alias("outcome"), (F.col("n_chars") > 5000).alias("review"))
    return trials.batch_report(d, "lang")


@query("batch_sizes", "SELECT event_id, user_id, greatest(1, floor(16 / power(2.0, coalesce(count(*) FILTER (event_id % 7 = 0) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::INTEGER AS batch_size FROM events")
def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("oom", F.col("event_id") % 7 == 0)
    return trials.batch_sizes(e, ["user_id"], ["ts", "event_id"], 16).select("event_id", "user_id", "batch_size")


@query(
    "refresh_points",
    "WITH s AS (SELECT user_id, ts, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 86400000000 AS span FROM events) SELECT DISTINCT * FROM (SELECT user_id, min(ts) AS ts FROM s GROUP BY user_id, span UNION ALL SELECT user_id, max(ts) FROM s GROUP BY user_id)",
)
def _refresh(spark: SparkSession, sf: str) -> DataFrame:
    return trials.refresh_points(table(spark, sf, "events").select("user_id", "ts"), ["user_id"], "ts", 86_400)


@query("reference_policy", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 AND o_orderstatus = 'F' THEN 'keep' ELSE 'refuse' END AS verdict FROM orders")
def _policy(spark: SparkSession, sf: str) -> DataFrame:
    known = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", trials.reference_policy(known, F.lit("F")).alias("verdict"))


@query(
    "resume_points",
    "WITH g AS (SELECT conv_id, count(*) AS n, min(turn) AS lo, max(turn) AS hi, count(DISTINCT turn) AS k FROM conversations GROUP BY 1), v AS (SELECT *, CASE WHEN NOT (lo = 0 AND hi = n - 1 AND k = n) THEN 'gaps' WHEN conv_id % 3 <> 1 THEN 'other settings' ELSE 'resume' END AS verdict FROM g) SELECT conv_id, verdict, CASE WHEN verdict = 'resume' THEN hi + 1 END AS next FROM v",
)
def _resume(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") % 3).cast("string").alias("settings"))
    return exports.resume_point(c, ["conv_id"], "turn", "settings", "1")

