"""Measures, windows and components of the driver's volumes, each with its DuckDB counterpart."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays as A
from .functions import draws
from .operators import spatial, stages
from .operators import measures as M
from .plans import evaluation, routing
from .queries import _CL, _VOX, SEED, _choice_sql, _normal, _u, _v, _vectors, query, r6, rounded
from .queries_more import _long
from .queries_volumes import _axis0, _d, _gauss, _three
from .sources.volumes import embedding_volumes

# quantiles

_POINTS = 16


def _grid(values: str) -> str:
    """The quantiles of a list at equal steps, by linear interpolation between its sorted values."""
    at = f"((len({values}) - 1) * k / {_POINTS - 1}.0)"
    return f"list_transform(range(0, {_POINTS}), lambda k: {values}[1 + floor({at})::INTEGER] + ({values}[least(len({values}), 2 + floor({at})::INTEGER)] - {values}[1 + floor({at})::INTEGER]) * ({at} - floor({at})))"


@query(
    "quantile_transfer",
    f"""WITH {_VOX}, p AS (SELECT vec_id, v, list_sort(list_filter(v, lambda x: x > 0)) AS own FROM vol), j AS (SELECT r.vec_id, r.v, r.own, d.own AS other FROM p r JOIN p d ON d.vec_id = r.vec_id + 1),
    q AS (SELECT vec_id, v, own, other, {_grid('own')} AS qa, {_grid('other')} AS qb FROM j),
    e AS (SELECT vec_id, unnest(range(0, 64)) AS idx, unnest(v) AS x, len(own) AS n, len(other) AS o, qa, qb FROM q),
    l AS (SELECT *, greatest(least(len(list_filter(qa, lambda t: t <= x)), {_POINTS - 1}), 1) AS low FROM e)
    SELECT vec_id, idx::INTEGER AS idx, round(CASE WHEN n < 8 OR o < 8 THEN x WHEN x <= 0 THEN 0.0 WHEN qa[low + 1] > qa[low] THEN qb[low] + (qb[low + 1] - qb[low]) * {_CL.format('(x - qa[low]) / (qa[low + 1] - qa[low])')} ELSE qb[low + 1] END, 6) + 0.0 AS value FROM l""",
)
def _transfer(spark: SparkSession, sf: str) -> DataFrame:
    """Each volume to the quantiles of the next one."""
    v = _vectors(spark, sf)
    donor = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("voxels").alias("donor"))
    out = v.join(donor, "vec_id").select("vec_id", M.quantile_transfer(F.col("voxels"), F.col("donor"), points=_POINTS).alias("voxels"))
    return rounded(out.select("vec_id", F.posexplode("voxels").alias("idx", "value")), "value")


# effects and gates

_PLATEAU = "SELECT vec_id, max(n) / sum(n) AS {0} FROM (SELECT vec_id, round_even({1} * 1024, 0) AS q, count(*) AS n FROM g WHERE m GROUP BY 1, 2) GROUP BY vec_id"
_EFFECTS = f"""f AS (SELECT vec_id, greatest(1e-6, coalesce(0.25 * quantile_cont(x, 0.01) FILTER (x > 0), 1e-6)) AS floor FROM e GROUP BY vec_id),
g AS (SELECT e.vec_id, x, m, floor, CASE WHEN x > 1e-6 AND y <= 1e-6 THEN greatest(2e-6, 0.01 * x) ELSE y END AS y, y AS raw, x > floor OR count(*) FILTER (x > floor) OVER (PARTITION BY vec_id) = 0 AS s FROM e JOIN f USING (vec_id)),
pb AS ({_PLATEAU.format('plateau_before', 'x')}), pa AS ({_PLATEAU.format('plateau', 'y')}),
r AS (SELECT vec_id, avg(abs(y - x)) AS mean_abs, avg(abs(y - x)) FILTER (s) AS support_mean_abs, avg((abs(y - x) > 1e-6)::INTEGER) AS changed, quantile_cont(abs(y - x), 0.99) FILTER (s) AS support_p99_abs,
  quantile_cont(x, 0.95) FILTER (s) - quantile_cont(x, 0.05) FILTER (s) AS range_before, quantile_cont(y, 0.95) FILTER (s) - quantile_cont(y, 0.05) FILTER (s) AS range_after, any_value(floor) AS support_floor,
  avg((y <= 1e-6)::INTEGER) FILTER (s) AS support_low, avg((y >= 1 - 1e-6)::INTEGER) FILTER (s) AS support_high, avg((y > floor)::INTEGER) FILTER (s) AS support_retention,
  avg(abs(y - x)) FILTER (m) AS mask_mean_abs, quantile_cont(abs(y - x), 0.99) FILTER (m) AS mask_p99_abs, sqrt(avg(y * y) FILTER (m)) / (sqrt(avg(x * x) FILTER (m)) + 1e-8) AS rms_ratio,
  avg((y <= 1e-6 AND x > 1e-6)::INTEGER) FILTER (m) AS new_zero, avg((y >= 1 - 1e-6 AND x < 1 - 1e-6)::INTEGER) FILTER (m) AS new_one, avg((y >= 1 - 1e-6)::INTEGER) FILTER (m) AS exact_one,
  avg((x > 1e-6 AND raw <= 1e-6)::INTEGER) FILTER (m) AS raw_new_zero, count(*) FILTER (x > 1e-6 AND raw <= 1e-6) / greatest(1, count(*) FILTER (x > 1e-6)) AS floor_share, avg(abs(raw - x)) AS step_abs FROM g GROUP BY vec_id),
h AS (SELECT r.*, range_after / (range_before + 1e-8) AS range_ratio, plateau_before, plateau, 0.15 AS zero_cap FROM r LEFT JOIN pb USING (vec_id) LEFT JOIN pa USING (vec_id))"""
_SCALED = f"e AS (SELECT vec_id, x, m, {_CL.format('CASE WHEN m THEN x * 1.6 ELSE greatest(x - 0.1, 0.0) END')} AS y FROM vox)"


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    """Brighter in the mask, darker outside, so that both ends are met."""
    rows = _vectors(spark, sf).withColumn("before", F.col("voxels"))
    pairs = F.arrays_zip("voxels", "mask")
    after = F.transform(pairs, lambda p: F.least(F.lit(1.0), F.when(p["mask"], p["voxels"] * 1.6).otherwise(F.greatest(p["voxels"] - 0.1, F.lit(0.0)))))
    return rows.withColumn("voxels", after)


@query("effect_metrics", f"WITH {_VOX}, {_SCALED}, {_EFFECTS} SELECT vec_id, {', '.join(f'round({k}, 6) + 0.0 AS {k}' for k in M.EFFECTS)} FROM h")
def _effects(spark: SparkSession, sf: str) -> DataFrame:
    rows = _changed(spark, sf)
    rows = rows.withColumn("voxels", M.raised_floor(F.col("before"), F.col("voxels")))
    e = M.effects(F.col("before"), F.col("voxels"), F.col("mask"))
    return rounded(rows.select("vec_id", e.alias("e")).select("vec_id", "e.*"), *M.EFFECTS)


_GATES = "CASE " + " ".join(f"WHEN {sql} THEN '{name}'" for name, sql in routing.VETOES) + " ELSE 'accept' END"


@query("hard_tail_verdicts", f"WITH {_VOX}, {_SCALED}, {_EFFECTS} SELECT vec_id, {_GATES} AS verdict FROM h")
def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _changed(spark, sf)
    step = F.aggregate(F.zip_with("voxels", "before", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 64
    return stages.judged(rows, "before", "voxels", F.lit("bias_erasing"), step).select("vec_id", "verdict")


# windows and components

_STARTS = "(SELECT i, j, k FROM range(0, 3) a(i), range(0, 3) b(j), range(0, 3) c(k))"


@query(
    "sliding_window_blend",
    f"""WITH {_VOX}, w AS (SELECT vec_id, idx, x, exp(-((a - i - 0.5) * (a - i - 0.5) + (b - j - 0.5) * (b - j - 0.5) + (c - k - 0.5) * (c - k - 0.5)) / (2 * 0.25 * 0.25)) AS w, 1.0 + ((i * 1000 + j) * 1000 + k) % 7 / 10.0 AS f
      FROM vox, {_STARTS} s WHERE a BETWEEN i AND i + 1 AND b BETWEEN j AND j + 1 AND c BETWEEN k AND k + 1)
    SELECT vec_id, idx::INTEGER AS idx, round(sum(w * x * f) / sum(w), 6) + 0.0 AS value FROM w GROUP BY vec_id, idx""",
)
def _sliding(spark: SparkSession, sf: str) -> DataFrame:
    blended = spatial.sliding_blend(_v(), 2, 1, lambda x, number: x * (1.0 + number % 7 / 10.0))
    return rounded(_vectors(spark, sf).select("vec_id", F.posexplode(blended).alias("idx", "value")), "value")


def _components(name: str, test: str) -> str:
    """CTEs of the 26-connected components of the voxels that pass a test: each voxel reaches all of its component, the least of them names it."""
    return f"""{name} AS (SELECT vec_id, idx, a, b, c FROM vox WHERE {test}),
    {name}_next AS (SELECT p.vec_id, p.idx AS f, q.idx AS t FROM {name} p JOIN {name} q ON p.vec_id = q.vec_id AND abs(p.a - q.a) <= 1 AND abs(p.b - q.b) <= 1 AND abs(p.c - q.c) <= 1),
    {name}_reach(vec_id, idx, root) AS (SELECT vec_id, idx, idx FROM {name} UNION SELECT r.vec_id, n.t, r.root FROM {name}_reach r JOIN {name}_next n ON n.vec_id = r.vec_id AND n.f = r.idx WHERE n.t > r.root),
    {name}_of AS (SELECT vec_id, idx, min(root) AS root FROM {name}_reach GROUP BY vec_id, idx), {name}_size AS (SELECT vec_id, root, count(*) AS n FROM {name}_of GROUP BY vec_id, root)"""


@query("largest_component", f"WITH RECURSIVE {_VOX}, {_components('q', 'm')} SELECT vol.vec_id, max(n) AS largest, count(n)::INTEGER AS components FROM vol LEFT JOIN q_size USING (vec_id) GROUP BY vol.vec_id")
def _largest(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.components(_vectors(spark, sf)).select("vec_id", F.get("component_sizes", 0).alias("largest"), F.size("component_sizes").alias("components"))


@query(
    "postprocess_mask",
    f"""WITH RECURSIVE {_VOX}, {_components('q', 'x >= 0.6')}, top AS (SELECT vec_id, max(n) AS top FROM q_size GROUP BY vec_id),
    kept AS (SELECT q_of.vec_id, q_of.idx FROM q_of JOIN q_size USING (vec_id, root) JOIN top USING (vec_id) WHERE n >= 0.3 * top),
    air AS (SELECT vox.vec_id, vox.idx, a, b, c FROM vox LEFT JOIN kept USING (vec_id, idx) WHERE kept.idx IS NULL),
    out(vec_id, idx, a, b, c) AS (SELECT vec_id, idx, a, b, c FROM air WHERE a IN (0, 3) OR b IN (0, 3) OR c IN (0, 3) UNION SELECT p.vec_id, p.idx, p.a, p.b, p.c FROM out o JOIN air p ON p.vec_id = o.vec_id AND abs(p.a - o.a) + abs(p.b - o.b) + abs(p.c - o.c) = 1),
    n AS (SELECT vol.vec_id, 64 - count(out.idx) AS filled FROM vol LEFT JOIN out USING (vec_id) GROUP BY vol.vec_id),
    d AS (SELECT vec_id, bool_or(n < 0.3 * top AND n >= 0.02 * top) AS dropped FROM q_size JOIN top USING (vec_id) GROUP BY vec_id)
    SELECT n.vec_id, CASE WHEN top IS NULL THEN 0 ELSE filled END::INTEGER AS voxels, coalesce(dropped, false) AS dropped_component,
      nullif(concat_ws(',', CASE WHEN top IS NULL THEN 'empty' END, CASE WHEN top IS NOT NULL AND filled / 64 < 0.02 THEN 'undersize' END, CASE WHEN top IS NOT NULL AND filled / 64 > 0.75 THEN 'oversize' END, CASE WHEN dropped THEN 'dropped_component' END), '') AS review
    FROM n LEFT JOIN top USING (vec_id) LEFT JOIN d USING (vec_id)""",
)
def _post(spark: SparkSession, sf: str) -> DataFrame:
    out = spatial.postprocess_masks(_vectors(spark, sf), threshold=0.6, keep_ratio=0.3)
    return out.select("vec_id", F.size(F.filter("mask", lambda m: m)).alias("voxels"), "dropped_component", evaluation.review_flags(F.col("mask_fraction"), F.col("dropped_component")).alias("review"))



# stages whose draws SQL can make

_TM = "tone_mapping"
_knot = lambda k: _d(_TM, "knot", k)
_KNOTS = f"list_sort([{', '.join(f'{k / 5.0!r} + -0.22 + 0.44 * {_knot(k)}' for k in range(6))}])"


@query(
    "stage_tone_mapping",
    f"""WITH {_VOX}, k AS (SELECT vec_id, list_transform({_KNOTS}, lambda y, i: CASE WHEN i = 1 THEN 0.0 ELSE least(greatest(y, 0.0), 1.15) END) AS ys, 0.7 + 0.8 * {_d(_TM, 'gamma')} AS g, 0.8 + 0.5 * {_d(_TM, 'contrast')} AS c2, -0.1 + 0.2 * {_d(_TM, 'brightness')} AS b2 FROM vol),
    t AS (SELECT vec_id, idx, ys, c2, b2, power({_CL.format('x')}, g) * 5 AS t FROM vox JOIN k USING (vec_id)), u AS (SELECT *, least(floor(t)::INTEGER, 4) AS n FROM t)
    SELECT vec_id, idx::INTEGER AS idx, round({_CL.format('0.5 + c2 * (ys[n + 1] + (t - n) * (ys[n + 2] - ys[n + 1]) - 0.5) + b2')}, 6) + 0.0 AS value FROM u""",
)
def _tone_stage(spark: SparkSession, sf: str) -> DataFrame:
    return _long(stages.tone_mapping(embedding_volumes(spark, sf), SEED))


_HALVED = [[(1 - t) * _gauss(2 / 3)[0][k] + t * _gauss(2 / 3)[3][k] for k in range(4)] for t in (0, 1 / 3, 2 / 3, 1)]
query("stage_resolution", f"WITH {_VOX} SELECT vec_id, idx::INTEGER AS idx, round({_axis0(_HALVED)}, 6) + 0.0 AS value FROM vox")(lambda spark, sf: _long(stages.resolution(embedding_volumes(spark, sf), SEED, factors=(2.0, 1.0, 1.0))))

_BF = "realistic_bias_field"
_TERMS = [(i, j, k) for i in range(3) for j in range(3) for k in range(3) if i + j + k]


def _bias_sql(strength: str) -> tuple[str, str]:
    """The weights of the field's terms as columns, and the field from them."""
    weights = ", ".join(f"(-1.0 + 2.0 * {_d(_BF, *t)}) * {strength} / {math.sqrt(26)!r} AS w{n}" for n, t in enumerate(_TERMS))
    wave = lambda n, t: " * ".join([f"w{n}", *(f"cos({math.pi * m!r} * ({p} + 0.5) / 4)" for m, p in zip(t, "abc", strict=True) if m)])
    return weights, f"exp(least(greatest({' + '.join(wave(n, t) for n, t in enumerate(_TERMS))}, -1.2), 1.2))"


_WEIGHTS, _FIELD = _bias_sql("0.5")


@query("stage_bias_field", f"WITH {_VOX}, w AS (SELECT vec_id, {_WEIGHTS} FROM vol) SELECT vec_id, idx::INTEGER AS idx, round(x * {_FIELD}, 6) + 0.0 AS value FROM vox JOIN w USING (vec_id)")
def _bias_stage(spark: SparkSession, sf: str) -> DataFrame:
    return _long(stages.bias_field(embedding_volumes(spark, sf), SEED))


_NOISE = f"({_d('realistic_noise', 'sigma')} * 0.05)"


@query("stage_noise", f"WITH {_VOX} SELECT vec_id, idx::INTEGER AS idx, round(x + {_NOISE} * {_normal('realistic_noise', 'n')}, 6) + 0.0 AS value FROM vox")
def _noise_stage(spark: SparkSession, sf: str) -> DataFrame:
    return _long(stages.additive_noise(embedding_volumes(spark, sf), SEED))


_SQ = ", ".join(f"'{k}': [{', '.join(map(repr, t))}]" for k, t in stages.SEQUENCES.items())
_CHOSEN = _choice_sql(_u(f"'{SEED}'", "vec_id", "'sequence'"), {k: 1.0 for k in stages.SEQUENCES})
_W3, _F3 = _bias_sql("0.225")


@query(
    "stage_sequences",
    f"""WITH {_VOX}, s AS (SELECT vec_id, quantile_cont(x, 0.33) FILTER (m) AS lo, quantile_cont(x, 0.67) FILTER (m) AS hi FROM vox GROUP BY vec_id), q AS (SELECT vec_id, {_CHOSEN} AS sequence, {_W3} FROM vol),
    t AS (SELECT vox.*, q.* EXCLUDE (vec_id), lo, hi, MAP {{{_SQ}}}[sequence] AS t FROM vox JOIN q USING (vec_id) JOIN s USING (vec_id)),
    r AS (SELECT *, {_CL.format("CASE WHEN m THEN 0.5 + 1.0 * (0.8 * CASE WHEN x < lo THEN t[1] WHEN x < hi THEN t[2] ELSE t[3] END + 0.2 * x - 0.5) ELSE x * t[4] END")} * {_F3} + {_d('realistic_noise', 'sigma')} * 0.018 * {_normal('realistic_noise', 'n')} AS y FROM t)
    SELECT vec_id, any_value(sequence) AS sequence, round(avg(y), 6) + 0.0 AS mean FROM r GROUP BY vec_id""",
)
def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    v = embedding_volumes(spark, sf).withColumn("sequence", draws.choice(draws.uniform(SEED, F.col("case_id"), "sequence"), {k: 1.0 for k in stages.SEQUENCES}))
    return stages.render_sequence(v, F.col("sequence"), seed=SEED).select(F.col("case_id").alias("vec_id"), "sequence", r6(A.mean(F.col("voxels"))).alias("mean"))


@query("stage_acquisition")
def _acquired(spark: SparkSession, sf: str) -> DataFrame:
    out = stages.realistic_acquisition(embedding_volumes(spark, sf), SEED)
    return out.select(F.col("case_id").alias("vec_id"), "acquisition.*", r6(A.mean(F.col("voxels"))).alias("mean"))


def _lag_sql(axis: str, lag: int) -> str:
    return f"(SELECT p.vec_id, CASE WHEN count(*) < 24 OR stddev_pop(p.r0) * stddev_pop(q.r0) < 1e-12 THEN 0.0 ELSE corr(p.r0, q.r0) END AS {axis}{lag} FROM res p JOIN res q ON p.vec_id = q.vec_id AND {' AND '.join(f'q.{o} = p.{o}' + (f' + {lag}' if o == axis else '') for o in 'abc')} GROUP BY p.vec_id)"


_LAGS = [(axis, lag) for lag in (1, 2) for axis in "abc"]
_SIGMAS = (0.6, 1.2, 2.4)


@query(
    "style_descriptor",
    f"""WITH {_VOX}, res AS (SELECT p.vec_id, p.idx, p.a, p.b, p.c, p.x, p.m, {', '.join(f'p.x - {_three(*[_gauss(s)] * 3)} AS r{k}' for k, s in enumerate(_SIGMAS))} FROM vox p JOIN vox q USING (vec_id) GROUP BY p.vec_id, p.idx, p.a, p.b, p.c, p.x, p.m),
    md AS (SELECT vec_id, {', '.join(f'median(r{k}) FILTER (m) AS m{k}' for k in range(3))} FROM res GROUP BY vec_id),
    sc AS (SELECT res.vec_id, {', '.join(f'CASE WHEN count(*) FILTER (m) < 2 THEN 0.0 ELSE 1.4826 * median(abs(r{k} - m{k})) FILTER (m) END AS s{k}' for k in range(3))} FROM res JOIN md USING (vec_id) GROUP BY res.vec_id),
    cd AS (SELECT vec_id, quantile_cont(x, [{', '.join(repr(k / 32) for k in range(33))}]) FILTER (m) AS cdf FROM vox GROUP BY vec_id)
    SELECT sc.vec_id, {', '.join(f'round(s{k}, 6) + 0.0 AS scale_{k}' for k in range(3))}, {', '.join(f'round({a}{n}, 6) + 0.0 AS lag_{n}_{a}' for a, n in _LAGS)}, {', '.join(f'round(cdf[{k + 1}], 6) + 0.0 AS q{k}' for k in (0, 1, 16, 31, 32))}
    FROM sc JOIN cd USING (vec_id) {' '.join(f'JOIN {_lag_sql(a, n)} l{a}{n} ON l{a}{n}.vec_id = sc.vec_id' for a, n in _LAGS)}""",
)
def _style(spark: SparkSession, sf: str) -> DataFrame:
    out = stages.style_descriptor(embedding_volumes(spark, sf), least=24)
    scales = [F.get("residual_scales", k).alias(f"scale_{k}") for k in range(3)]
    lags = [F.get("lags", k).alias(f"lag_{n}_{a}") for k, (a, n) in enumerate(_LAGS)]
    cdf = [F.get("cdf", k).alias(f"q{k}") for k in (0, 1, 16, 31, 32)]
    done = out.select(F.col("case_id").alias("vec_id"), *scales, *lags, *cdf)
    return rounded(done, *done.columns[1:])
