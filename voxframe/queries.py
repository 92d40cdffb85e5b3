"""The library's queries on the driver's tables, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .functions import arrays as A
from .functions import draws
from .functions import scores as S
from .functions.tasks import parts_for
from .operators import OPERATORS, apply_operator, catalogue as operator_catalogue
from .operators import measures as M
from .operators import spatial, stages
from .plans import catalogue, evaluation, recovery, routing, splits
from .sources import listings
from .sources.volumes import embedding_volumes, normalize_intensity, zscore
from .streaming import trials as trial_streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


# SQL pieces

_NORMAL = """raw AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
st AS (SELECT vec_id, label, e, len(list_filter(e, lambda x: x < 0)) AS neg, list_aggregate(e, 'quantile_cont', 0.01) AS p1, list_aggregate(e, 'quantile_cont', 0.99) AS p99,
  list_aggregate(list_filter(e, lambda x: x > 0), 'quantile_cont', 0.99) AS top FROM raw),
s2 AS (SELECT *, CASE WHEN p99 <= p1 THEN list_min(e) ELSE p1 END AS lo, CASE WHEN p99 <= p1 THEN list_max(e) ELSE p99 END AS hi FROM st),
nv AS (SELECT vec_id, label, CASE WHEN neg > 0.01 * len(e) THEN list_transform(e, lambda x: CASE WHEN hi > lo THEN least(greatest((x - lo) / (hi - lo), 0.0), 1.0) ELSE 0.0 END)
  ELSE list_transform(e, lambda x: CASE WHEN top IS NULL THEN 0.0 ELSE least(greatest(x, 0.0), top) / (top + 1e-8) END) END AS v FROM s2),
vol AS (SELECT vec_id, label, v, list_aggregate(v, 'median') AS med FROM nv)"""
_VOX = f"""{_NORMAL},
vox AS (SELECT vec_id, label, v, i - 1 AS idx, v[i] AS x, v[i] > med AS m, (i - 1) // 16 AS a, ((i - 1) // 4) % 4 AS b, (i - 1) % 4 AS c FROM vol, range(1, 65) t(i))"""


def _u(*parts: str) -> str:
    """A keyed draw in SQL; parts are SQL text expressions."""
    return f"(('0x' || substr(sha256({' || chr(58) || '.join(parts)}), 1, 8))::BIGINT / 4294967296.0)"


def _at(a: str = "a", b: str = "b", c: str = "c") -> str:
    return f"v[1 + 16 * ({a}) + 4 * ({b}) + ({c})]"


def _volume_sql(value: str, stats: str = "") -> str:
    """vec_id, idx and value of every voxel; `stats` is a further query by vec_id, if one is needed."""
    joined = f", s AS ({stats}) SELECT vec_id, idx::INTEGER AS idx, round({value}, 6) + 0.0 AS value FROM vox JOIN s USING (vec_id)" if stats else f" SELECT vec_id, idx::INTEGER AS idx, round({value}, 6) + 0.0 AS value FROM vox"
    return f"WITH {_VOX}{joined}"


SEED = 7


def volume_query(operator: str, severity: float, sql: str | None = None, key: str | None = None, **params) -> None:
    """Registers an operator over all volumes: vec_id, idx, value."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = apply_operator(embedding_volumes(spark, sf), operator, severity, SEED, **params)
        return out.select(F.col("case_id").alias("vec_id"), F.posexplode("voxels").alias("idx", "value")).select("vec_id", "idx", r6(F.when(F.isnan("value"), None).otherwise(F.col("value"))).alias("value"))

    query(key or f"vol_{operator}", sql)(run)


_CL = "least(greatest({}, 0.0), 1.0)"
volume_query("clipping", 0.4, _volume_sql("least(x, cap)", "SELECT vec_id, quantile_cont(x, 0.895) AS cap FROM vox WHERE m GROUP BY vec_id"))
volume_query("clipping", 0.4, _volume_sql("least(x, cap)", "SELECT vec_id, quantile_cont(x, 0.8) AS cap FROM vox WHERE x > 0 GROUP BY vec_id"), key="vol_clipping_percentile", percentile=80.0)
volume_query("quantization", 0.5, _volume_sql("CASE WHEN hi > lo THEN lo + (hi - lo) * (round_even((x - lo) / (hi - lo) * 7, 0) / 7) ELSE x END", "SELECT vec_id, min(x) AS lo, max(x) AS hi FROM vox GROUP BY vec_id"), levels=8, lut_warp=1.0, dither=False)
volume_query("constant", 0.5, _volume_sql("coalesce(md, 1.0)", "SELECT vec_id, median(x) FILTER (WHERE x > 0) AS md FROM vox GROUP BY vec_id"))
volume_query("brain_intensity", 0.7, _volume_sql(_CL.format("CASE WHEN m THEN x * 0.7 ELSE x END")))
volume_query("skull_intensity", 1.4, _volume_sql(_CL.format("CASE WHEN NOT m AND x > 0.1 THEN x * 1.4 ELSE x END")))
volume_query("brain_contrast", 1.5, _volume_sql(_CL.format("CASE WHEN m THEN (x - mu) * 1.5 + mu ELSE x END"), "SELECT vec_id, avg(x) FILTER (WHERE m) AS mu FROM vox GROUP BY vec_id"))
volume_query("skull_contrast", 1.5, _volume_sql(_CL.format("CASE WHEN NOT m AND x > 0.1 AND mu IS NOT NULL THEN (x - mu) * 1.5 + mu ELSE x END"), "SELECT vec_id, avg(x) FILTER (WHERE NOT m AND x > 0.1) AS mu FROM vox GROUP BY vec_id"))
_R2 = "((a-1.5)*(a-1.5)+(b-1.5)*(b-1.5)+(c-1.5)*(c-1.5))"
volume_query("metal_dipole", 0.5, _volume_sql(f"x + 0.6 * (3.0 * ((c-1.5)*(c-1.5)) / {_R2} - 1.0) * exp(-{_R2} / 8.0)"), radius=2.0)
volume_query("metal_void", 0.5, _volume_sql(f"x * (1.0 - 0.7 * exp(-{_R2} / 4.5))"), radius=1.5)
volume_query("metal_pileup", 0.5, _volume_sql(f"x + 0.4 * exp(-((sqrt({_R2}) - 1.5) * (sqrt({_R2}) - 1.5)) / 2.0)"), radius=1.5, width=1.0)
_M3 = "((a-1.0)*(a-1.0)+(b-2.0)*(b-2.0)+(c-1.0)*(c-1.0))"
_MR = 0.12 * 4 * (0.6 + 0.4 * 1.0)
volume_query("metal_3d", 1.0, _volume_sql(_CL.format(f"x * (1.0 - 0.7 * exp(-{_M3} / {2 * _MR**2})) + 0.35 * (3.0 * (CASE WHEN {_M3} <> 0 THEN ((c-1.0)*(c-1.0)) / {_M3} ELSE 0.0 END) - 1.0) * exp(-{_M3} / {4.5 * _MR**2}) * x + 0.3 * exp(-(sqrt({_M3}) - {1.2 * _MR}) * (sqrt({_M3}) - {1.2 * _MR}) / {0.18 * _MR**2}) * x")), loc=(1, 2, 1))
volume_query("spin_history", 0.5, _volume_sql(_CL.format("x * (1.0 + CASE WHEN c % 2 = 0 THEN 0.18 ELSE -0.09 END + 0.1 * (c / 3.0 - 0.5))")), k=2, drift=0.1)
volume_query("aliasing", 0.5, _volume_sql(f"CASE WHEN a < 1 THEN (x + 0.9 * {_at(a='3 + a')}) / 1.9 ELSE x END"), direction="low")
volume_query("slab_wrap", 0.5, _volume_sql(f"(x + 0.5 * {_at(c='(c - 1 + 4) % 4')}) / 1.5"), axis=2, both=False, weight=0.5, jitter=1.0)
_GH = f"x + 0.3 * {_at(b='(b - 2 + 4) % 4')}"
volume_query("ghosting", 0.5, _volume_sql(_CL.format(f"CASE WHEN hi > 1 THEN ({_GH}) / hi ELSE {_GH} END"), f"SELECT vec_id, quantile_cont({_GH}, 0.995) AS hi FROM vox GROUP BY vec_id"), n_ghosts=1, amplitude=0.3)
volume_query("motion_pe_replicas", 0.5, _volume_sql(f"0.5 * x + 0.3 * {_at(a='(a - 1 + 4) % 4')} + 0.2 * {_at(a='(a - 2 + 4) % 4')}"), shifts=(1, 2), alphas=(0.3, 0.2))
volume_query("motion_ghost_stack", 0.5, _volume_sql(f"0.8 * (0.7 * x + 0.3 * {_at(a='(a - 1 + 4) % 4')}) + 0.2 * {_at(a='(a - 2 + 4) % 4')}"), offsets=(1, 2), alphas=(0.3, 0.2))
volume_query(
    "motion_pulsation", 0.5,
    _volume_sql(_CL.format(f"CASE WHEN n >= 8 AND {_at(a='(a - 1 + 4) % 4')} > md AND {_at(a='(a - 1 + 4) % 4')} >= bar THEN x + 0.4 * {_at(a='(a - 1 + 4) % 4')} ELSE x END"), "SELECT vox.vec_id, count(*) FILTER (WHERE m) AS n, quantile_cont(x, 0.8) FILTER (WHERE m) AS bar, any_value(med) AS md FROM vox JOIN vol USING (vec_id) GROUP BY vox.vec_id"),
    offsets=(1,), alphas=(0.4,), bright_pct=80.0, least=8,
)
volume_query(
    "bounce_point_null", 0.5,
    _volume_sql(f"CASE WHEN x > 0 AND sg > 0 THEN {_CL.format('x * (1.0 - 0.8 * exp(-((x - nl) * (x - nl)) / (2.0 * sg * sg))) + 0.25 * greatest(0.0, 1.0 - abs(x - nl) / sg) * abs(x - nl)')} ELSE x END", "SELECT vec_id, lo + (hi - lo) * 0.4 AS nl, (hi - lo) * 0.15 AS sg FROM (SELECT vec_id, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM vox WHERE x > 0 GROUP BY vec_id)"),
    centre=0.4, width=0.15,
)
_T = "least(greatest((x - lo) / (hi - lo), 0.0), 1.0)"
volume_query("mp2rage_lut", 0.5, _volume_sql(f"CASE WHEN m AND hi > lo THEN CASE WHEN {_T} <= 0 THEN 0.1 WHEN {_T} <= 0.5 THEN 0.1 + {_T} * 1.2 ELSE 0.7 + ({_T} - 0.5) * 0.4 END ELSE x END", "SELECT vec_id, quantile_cont(x, 0.005) AS lo, quantile_cont(x, 0.995) AS hi FROM vox WHERE m GROUP BY vec_id"), xs=(0.0, 0.5, 1.0), ys=(0.1, 0.7, 0.9))
volume_query("nyquist_ghost", 0.5, _volume_sql(f"sqrt((cos(0.3) * x) * (cos(0.3) * x) + (sin(0.3) * {_at(b='(b + 2) % 4')}) * (sin(0.3) * {_at(b='(b + 2) % 4')}))"), delta=0.3)
volume_query("noise_overlay", 0.2, _volume_sql(_CL.format("x + 0.2 * " + _u("'7'", "vec_id", "'noise_overlay'", "'n'", "idx"))))
volume_query("nonfinite", 0.05, f"WITH {_VOX} SELECT vec_id, idx::INTEGER AS idx, CASE WHEN {_u(chr(39) + '7' + chr(39), 'vec_id', chr(39) + 'nonfinite' + chr(39), chr(39) + 'n' + chr(39), 'idx')} < 0.05 THEN NULL ELSE round(x, 6) + 0.0 END AS value FROM vox")


def _normal(name: str, draw: str) -> str:
    a, b = (_u("'7'", "vec_id", f"'{name}'", f"'{draw}'", "idx", f"'{p}'") for p in "ab")
    return f"(sqrt(-2 * ln(greatest({a}, {2.0**-33!r}))) * cos({2 * math.pi!r} * {b}))"


volume_query("mp2rage_tissue_noise", 0.1, _volume_sql(f"CASE WHEN m THEN x + 0.1 * {_normal('mp2rage_tissue_noise', 'n')} ELSE x END"))
_RS = "(0.03 + 0.45 * 0.3) * coalesce(p90, 0.0)"
volume_query("rician_noise", 0.3, _volume_sql(f"sqrt(pow(x + {_RS} * {_normal('rician_noise', 'a')}, 2) + pow({_RS} * {_normal('rician_noise', 'b')}, 2))", "SELECT vec_id, quantile_cont(x, 0.9) FILTER (WHERE x > 0) AS p90 FROM vox GROUP BY vec_id"))
_DK = lambda *p: _u("'7'", "vec_id", "'dropout'", *p)
volume_query("dropout", 0.5, f"WITH {_VOX}, r AS (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY {_DK(chr(39) + 'slice' + chr(39), 'k')}, k) AS n FROM vol, range(0, 4) t(k)) SELECT vec_id, idx::INTEGER AS idx, round(CASE WHEN n <= 2 THEN x * (1.0 - (0.5 + 0.5 * {_DK(chr(39) + 'loss' + chr(39), 'c')})) ELSE x END, 6) + 0.0 AS value FROM vox JOIN r USING (vec_id) WHERE r.k = c")


def _lobe_sql(name: str, low: float, high: float) -> str:
    d = lambda *p: _u("'7'", "vec_id", f"'{name}'", *p)
    strength = f"(({low} + {high - low!r} * {d(chr(39) + 'strength' + chr(39))}) * 0.5 * CASE WHEN {d(chr(39) + 'sign' + chr(39))} < 0.5 THEN -1.0 ELSE 1.0 END)"
    stats = f"SELECT vec_id, {strength} AS st, (0.06 + {0.13 - 0.06!r} * {d(chr(39) + 'scale' + chr(39))}) * 4.0 AS sg, " + ", ".join(f"(0.2 + {0.8 - 0.2!r} * {d(chr(39) + f'c{k}' + chr(39))}) * 3 AS c{k}" for k in range(3)) + " FROM vol"
    return _volume_sql(_CL.format("x * (1.0 + st * exp(-((a-c0)*(a-c0)+(b-c1)*(b-c1)+(c-c2)*(c-c2)) / (2.0 * sg * sg)))"), stats)


volume_query("draw_shape", 0.5, _lobe_sql("draw_shape", 0.3, 0.8))
volume_query("draw_shape_opacity", 0.5, _lobe_sql("draw_shape_opacity", 0.1, 0.3))
# Lines 0, and those near the centre, of a transform over 4 lines: a circulant kernel of the real part.
volume_query("pe_undersample", 0.0001, _volume_sql(f"0.5 * x + 0.5 * {_at(b='(b + 2) % 4')}"), centre_share=0.0)
volume_query("dc_offset", 0.5, _volume_sql(_CL.format(f"x + CASE WHEN {_u(chr(39) + '7' + chr(39), 'vec_id', chr(39) + 'dc_offset' + chr(39), chr(39) + 'sign' + chr(39))} < 0.5 THEN -1.0 ELSE 1.0 END * (0.05 + 0.2 * {_u(chr(39) + '7' + chr(39), 'vec_id', chr(39) + 'dc_offset' + chr(39), chr(39) + 'offset' + chr(39))}) * 0.5")), flat=True)
for _name, _op in OPERATORS.items():  # those without a counterpart in SQL: results are held against NumPy and properties by the tests
    if f"vol_{_name}" not in QUERIES:
        volume_query(_name, min(_op.severity[1], 0.5) if _op.severity[0] < 1 else 2.0, **({"radius": 1.0} if _name in ("blob", "void") else {}))


# measures of volumes


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_volumes(spark, sf).withColumnRenamed("case_id", "vec_id")


def _measure(name: str, sql: str | None, **columns: Callable[[], Column]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _vectors(spark, sf).select("vec_id", *[f().alias(k) for k, f in columns.items()])

    query(name, sql)(run)


def _v() -> M.ColumnVolume:
    return M.volume(F.col("voxels"), F.col("shape"), F.col("mask"))


@query("normalize_intensity", f"WITH {_VOX} SELECT vec_id, idx::INTEGER AS idx, round(x, 6) + 0.0 AS value FROM vox")
def _normalize(spark, sf):
    rows = embedding_volumes(spark, sf, normalized=False).withColumn("voxels", normalize_intensity(F.col("voxels")))
    return rows.select(F.col("case_id").alias("vec_id"), F.posexplode("voxels").alias("idx", "value")).withColumn("value", r6(F.col("value")))


@query("zscore", _volume_sql("(x - mu) / (sd + 1e-8)", "SELECT vec_id, avg(x) AS mu, stddev_pop(x) AS sd FROM vox WHERE m GROUP BY vec_id"))
def _zscore(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.posexplode(zscore(F.col("voxels"), F.col("mask"))).alias("idx", "value")).withColumn("value", r6(F.col("value")))


@query("tone_map", f"WITH {_VOX}, t AS (SELECT vec_id, idx, pow(x, 1.2) * 2 AS t FROM vox) SELECT vec_id, idx::INTEGER AS idx, round({_CL.format('((CASE WHEN t <= 0 THEN 0.0 WHEN t <= 1 THEN t * 0.6 ELSE 0.6 + (t - 1) * 0.4 END) - 0.5) * 1.1 + 0.5 + 0.05')}, 6) + 0.0 AS value FROM t")
def _tone(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.posexplode(M.tone_map(F.col("voxels"), 1.2, [0.0, 0.6, 1.0], 1.1, 0.05)).alias("idx", "value")).withColumn("value", r6(F.col("value")))


_measure("robust_sigma", f"WITH {_VOX}, d AS (SELECT vox.vec_id, median(abs(x - med)) AS d FROM vox JOIN vol USING (vec_id) GROUP BY vox.vec_id) SELECT vec_id, round(1.4826 * d, 6) + 0.0 AS sigma FROM d", sigma=lambda: r6(M.robust_sigma(F.col("voxels"))))
_measure("plateau_fraction", f"WITH {_VOX}, g AS (SELECT vec_id, round_even(x * 1024, 0) AS q, count(*) AS n FROM vox GROUP BY 1, 2) SELECT vec_id, round(max(n) / 64.0, 6) + 0.0 AS plateau FROM g GROUP BY vec_id", plateau=lambda: r6(M.plateau_fraction(F.col("voxels"))))
_measure(
    "otsu_threshold",
    f"""WITH {_VOX}, h AS (SELECT vec_id, least(floor(x * 16), 15)::INTEGER AS k, count(*) AS n FROM vox GROUP BY 1, 2), g AS (SELECT vec_id, t.k, coalesce(n, 0)::DOUBLE AS n FROM (SELECT vec_id, k FROM vol, range(0, 16) r(k)) t LEFT JOIN h USING (vec_id, k)),
    w AS (SELECT vec_id, k, sum(n) OVER o AS w, sum(n * (k + 0.5) / 16) OVER o AS m, sum(n) OVER p AS tn, sum(n * (k + 0.5) / 16) OVER p AS tm FROM g WINDOW o AS (PARTITION BY vec_id ORDER BY k), p AS (PARTITION BY vec_id)),
    b AS (SELECT vec_id, k, CASE WHEN w > 0 AND w < tn THEN round((tm * w - m * tn) * (tm * w - m * tn) / (w * (tn - w)), 9) ELSE 0.0 END AS v FROM w)
    SELECT vec_id, round((arg_max(k, v * 1000 - k * 1e-9) + 0.5) / 16, 6) + 0.0 AS threshold FROM b GROUP BY vec_id""",
    threshold=lambda: r6(M.otsu(F.col("voxels"), 16)),
)
_measure(
    "lag_correlation",
    f"WITH {_VOX}, p AS (SELECT vec_id, x, {_at(c='c + 1')} AS y FROM vox WHERE c < 3) SELECT vec_id, round(corr(x, y), 6) + 0.0 AS lag1 FROM p GROUP BY vec_id",
    lag1=lambda: r6(M.lag_correlation(_v(), 2, 1, least=8)),
)


@query("bbox_centroid", f"WITH {_VOX} SELECT vec_id, min(a)::INTEGER AS low_i, max(a)::INTEGER AS high_i, min(b)::INTEGER AS low_j, max(c)::INTEGER AS high_k, round(avg(a), 6) + 0.0 AS ci, round(avg(b), 6) + 0.0 AS cj, round(avg(c), 6) + 0.0 AS ck, count(*)::INTEGER AS n FROM vox WHERE m GROUP BY vec_id")
def _bbox(spark, sf):
    b = _vectors(spark, sf).select("vec_id", M.bounding_box(_v()).alias("x")).filter("x.n > 0")
    return b.select("vec_id", F.get("x.low", 0).alias("low_i"), F.get("x.high", 0).alias("high_i"), F.get("x.low", 1).alias("low_j"), F.get("x.high", 2).alias("high_k"), *[r6(F.get("x.centroid", k)).alias(n) for k, n in enumerate(("ci", "cj", "ck"))], F.col("x.n").alias("n"))


@query("top_fraction_support", f"WITH {_VOX}, r AS (SELECT vec_id, idx, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, idx) AS n FROM vox) SELECT vec_id, idx::INTEGER AS idx FROM r WHERE n <= 7")
def _support(spark, sf):
    v = _vectors(spark, sf).select("vec_id", F.posexplode(M.top_fraction(F.col("voxels"), 0.1)).alias("idx", "keep"))
    return v.filter("keep").select("vec_id", "idx")


@query("flip_tta_mean", _volume_sql(f"(x + {_at(a='3 - a')} + {_at(b='3 - b')} + {_at(c='3 - c')}) / 4.0"))
def _tta(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.posexplode(spatial.flip_mean(_v())).alias("idx", "value")).withColumn("value", r6(F.col("value")))


@query("orientation_roundtrip", f"WITH {_VOX} SELECT vec_id, idx::INTEGER AS idx, round({_at(a='c', b='3 - a', c='b')}, 6) + 0.0 AS turned, round(x, 6) + 0.0 AS back FROM vox")
def _orientation(spark, sf):
    order, flips = (1, 2, 0), (True, False, False)
    turned, shape = spatial.reorient(_v(), order, flips)
    rows = _vectors(spark, sf).withColumn("t", turned).withColumn("ts", shape)
    back, _ = spatial.reorient(M.volume(F.col("t"), F.col("ts")), *spatial.inverse_orientation(order, flips))
    rows = rows.withColumn("b", back).select("vec_id", F.posexplode(F.arrays_zip("t", "b")).alias("idx", "p"))
    return rows.select("vec_id", "idx", r6(F.col("p.t")).alias("turned"), r6(F.col("p.b")).alias("back"))


_LOSS = f"WITH {_VOX}, q AS (SELECT vec_id, x AS p, m::INTEGER::DOUBLE AS t, (x - 0.5) * 4 AS z FROM vox) SELECT vec_id, "
_measure("tversky_loss", _LOSS + "round(1.0 - (sum(p*t) + 1e-6) / (sum(p*t) + 0.3*sum(p*(1-t)) + 0.7*sum((1-p)*t) + 1e-6), 6) + 0.0 AS loss FROM q GROUP BY vec_id", loss=lambda: r6(S.tversky_loss(F.col("voxels"), F.col("mask"))))
_measure("bce_loss", _LOSS + "round(avg((1-t)*z + (1 + t) * (ln(1 + exp(-abs(z))) + greatest(-z, 0.0))), 6) + 0.0 AS loss FROM q GROUP BY vec_id", loss=lambda: r6(S.bce_loss(F.transform("voxels", lambda x: (x - 0.5) * 4), F.col("mask"), 2.0)))


# stages


@query("stage_overlay")
def _overlay(spark, sf):
    out = stages.overlay(embedding_volumes(spark, sf), SEED)
    return out.select(F.col("case_id").alias("vec_id"), "artifacts", r6(A.mean(F.col("voxels"))).alias("mean"))


@query("stage_appearance")
def _appearance(spark, sf):
    return stages.appearance(embedding_volumes(spark, sf), SEED).select(F.col("case_id").alias("vec_id"), r6(A.mean(F.col("voxels"))).alias("mean"), r6(A.std(F.col("voxels"))).alias("std"))


# evaluation

_COUNTS = f"WITH {_VOX}, c AS (SELECT vec_id, label, count(*) FILTER (WHERE x > 0.6 AND m) AS tp, count(*) FILTER (WHERE x > 0.6 AND NOT m) AS fp, count(*) FILTER (WHERE NOT x > 0.6 AND m) AS fn, count(*) FILTER (WHERE NOT x > 0.6 AND NOT m) AS tn FROM vox GROUP BY 1, 2)"
_SCORE = "CASE WHEN 2*tp+fp+fn = 0 THEN 1.0 ELSE 2.0*tp/(2*tp+fp+fn) END AS dice, CASE WHEN tp+fp+fn = 0 THEN 1.0 ELSE tp::DOUBLE/(tp+fp+fn) END AS iou, CASE WHEN tp+fp = 0 THEN NULL ELSE tp::DOUBLE/(tp+fp) END AS \"precision\", CASE WHEN tp+fn = 0 THEN NULL ELSE tp::DOUBLE/(tp+fn) END AS recall"
_FOUR = ("dice", "iou", "precision", "recall")


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf).withColumn("prediction", F.transform("voxels", lambda x: x > 0.6))
    return evaluation.evaluate(v).select("vec_id", "label", *evaluation.COUNTS, *_FOUR)


@query("dice_per_volume", _COUNTS + f", s AS (SELECT *, {_SCORE} FROM c) SELECT vec_id, label, tp, fp, fn, tn, round(dice, 6) + 0.0 AS dice, round(iou, 6) + 0.0 AS iou, round(\"precision\", 6) + 0.0 AS \"precision\", round(recall, 6) + 0.0 AS recall FROM s")
def _dice(spark, sf):
    return rounded(_evaluated(spark, sf), *_FOUR)


@query("macro_metrics", _COUNTS + f", s AS (SELECT *, {_SCORE} FROM c) SELECT label, " + ", ".join(f"round(avg(\"{m}\"), 6) + 0.0 AS {m}_mean, round(stddev_pop(\"{m}\"), 6) + 0.0 AS {m}_std, count(\"{m}\") AS {m}_defined" for m in _FOUR) + " FROM s GROUP BY label")
def _macro(spark, sf):
    return rounded(evaluation.macro(_evaluated(spark, sf), "label"), *[f"{m}_{k}" for m in _FOUR for k in ("mean", "std")])


@query("micro_metrics", _COUNTS + f", g AS (SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM c GROUP BY label), s AS (SELECT *, {_SCORE} FROM g) SELECT label, tp, fp, fn, tn, round(dice, 6) + 0.0 AS dice, round(iou, 6) + 0.0 AS iou, round(\"precision\", 6) + 0.0 AS \"precision\", round(recall, 6) + 0.0 AS recall FROM s")
def _micro(spark, sf):
    return rounded(evaluation.micro(_evaluated(spark, sf), "label"), *_FOUR)


@query("five_number_summary", _COUNTS + f", s AS (SELECT *, {_SCORE} FROM c) SELECT label, round(avg(dice), 6) + 0.0 AS mean, round(stddev_pop(dice), 6) + 0.0 AS std, round(median(dice), 6) + 0.0 AS median, round(min(dice), 6) + 0.0 AS min, round(quantile_cont(dice, 0.1), 6) + 0.0 AS p10, round(avg((dice >= 0.99)::INTEGER), 6) + 0.0 AS share_99 FROM s GROUP BY label")
def _five(spark, sf):
    return rounded(evaluation.five_number(_evaluated(spark, sf), "dice", "label"), "mean", "std", "median", "min", "p10", "share_99")


@query("undefined_precision_null", f"WITH c AS (SELECT source, lang, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2), s AS (SELECT *, {_SCORE} FROM c) SELECT source, lang, tp, fp, fn, tn, round(dice, 6) + 0.0 AS dice, round(iou, 6) + 0.0 AS iou, round(\"precision\", 6) + 0.0 AS \"precision\", round(recall, 6) + 0.0 AS recall FROM s")
def _undefined(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    counts = rows.groupBy("source", "lang").agg(*[F.count_if(c).alias(k) for k, c in (("tp", q & t), ("fp", q & ~t), ("fn", ~q & t), ("tn", ~q & ~t))])
    return rounded(evaluation.scored(counts), *_FOUR)


_TRIALS = """t AS (SELECT user_id AS "case", event_type AS condition, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS repeat,
 CASE WHEN event_id % 10 = 0 THEN 'failed' WHEN event_id % 10 = 1 THEN 'unchanged' ELSE 'ok' END AS status, 1 / (1 + value / 100) AS score, event_id FROM events)"""


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    """The event log as a trial log: a user is a case, an event type a condition."""
    e = table(spark, sf, "events")
    e = e.repartition(parts_for(e), "user_id", "event_type")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    status = F.when(F.col("event_id") % 10 == 0, "failed").when(F.col("event_id") % 10 == 1, "unchanged").otherwise("ok")
    return e.select(F.col("user_id").alias("case"), F.col("event_type").alias("condition"), (F.row_number().over(w) - 1).alias("repeat"), status.alias("status"), (1 / (1 + F.col("value") / 100)).alias("score"), "event_id")


@query(
    "case_balanced_summary",
    f"""WITH {_TRIALS}, u AS (SELECT DISTINCT "case" FROM t), k AS (SELECT DISTINCT condition FROM t), p AS (SELECT "case", condition, r AS repeat FROM u, k, range(0, 3) x(r)),
    j AS (SELECT p.*, t.status, CASE WHEN t.status = 'ok' THEN t.score END AS s FROM p LEFT JOIN t USING ("case", condition, repeat)),
    c AS (SELECT "case", condition, avg(s) AS s, count(*) AS expected, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status IS NULL) AS pending FROM j GROUP BY 1, 2),
    q AS (SELECT "case" % 3 AS tier, "case", avg(s) AS s, sum(expected) AS expected, sum(ok) AS ok, sum(failed) AS failed, sum(unchanged) AS unchanged, sum(pending) AS pending FROM c GROUP BY 1, 2)
    SELECT tier, round(avg(s) FILTER (WHERE ok = expected), 6) + 0.0 AS mean_score, round(avg(s), 6) + 0.0 AS available_score, count(*) FILTER (WHERE ok = expected) AS complete_cases, count(*) AS cases, sum(expected)::BIGINT AS expected, sum(ok)::BIGINT AS ok, sum(failed)::BIGINT AS failed, sum(unchanged)::BIGINT AS unchanged, sum(pending)::BIGINT AS pending,
    CASE WHEN sum(pending) > 0 THEN 'interrupted' WHEN sum(failed) > 0 THEN 'completed_with_failures' WHEN sum(unchanged) > 0 THEN 'completed_with_unchanged_trials' ELSE 'completed' END AS report FROM q GROUP BY tier""",
)
def _balanced(spark, sf):
    t = _trials(spark, sf)
    conditions = [r[0] for r in t.select("condition").distinct().orderBy("condition").collect()]  # the catalogue of conditions
    plan = t.select("case").distinct().withColumn("condition", F.explode(F.array(*map(F.lit, conditions)))).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("tier", F.col("case") % 3)
    out = evaluation.case_balanced(t, plan, "tier").withColumn("report", evaluation.report_status(F.col("failed"), F.col("unchanged"), F.col("pending")))
    return rounded(out, "mean_score", "available_score")


@query("trial_status_counts", f"WITH {_TRIALS} SELECT condition, count(*) AS trials, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'unchanged') AS unchanged FROM t GROUP BY condition")
def _statuses(spark, sf):
    hit = lambda s: F.count_if(F.col("status") == s).alias(s)
    return _trials(spark, sf).groupBy("condition").agg(F.count(F.lit(1)).alias("trials"), hit("ok"), hit("failed"), hit("unchanged"))


@query("journal_counts", f"""WITH {_TRIALS} SELECT "case", count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (WHERE status = 'failed') AS failed_ids FROM t GROUP BY 1""")
def _journal(spark, sf):
    failed = F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("event_id"))))
    return _trials(spark, sf).groupBy("case").agg(F.count(F.lit(1)).alias("n"), F.nullif(F.array_join(F.transform(failed, lambda x: x.cast("string")), ","), F.lit("")).alias("failed_ids"))


@query("review_flags", "SELECT doc_id, nullif(concat_ws(',', CASE WHEN f = 0 THEN 'empty' END, CASE WHEN f > 0 AND f < 0.02 THEN 'undersize' END, CASE WHEN f > 0.75 THEN 'oversize' END, CASE WHEN doc_id % 7 = 0 THEN 'dropped_component' END), '') AS review FROM (SELECT doc_id, least(1.0, n_chars / 5000.0) AS f FROM documents)")
def _review(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", evaluation.review_flags(F.least(F.lit(1.0), F.col("n_chars") / 5000.0), F.col("doc_id") % 7 == 0).alias("review"))


@query("windowed_trials", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean_value FROM events GROUP BY 1, 2")
def _windowed(spark, sf):
    return rounded(trial_streams.windowed_counts(table(spark, sf, "events")), "mean_value")


# catalogue and plans


def _sql_rows(rows: list[tuple]) -> str:
    """Python values as rows of a SQL VALUES list."""

    def one(v) -> str:
        return "NULL" if v is None else repr(v) if isinstance(v, float | int) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else "'" + str(v) + "'"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


_DRAWN = _u("'5'", "doc_id", "'entry'")
_ENTRIES = [(n, o.name, o.kind, o.dims, float(o.severity[0]), float(o.severity[1]), bool(o.pool)) for n, o in enumerate(OPERATORS.values())]


def _entry(of: int) -> Column:
    """The number of the catalogue's entry that a document draws."""
    return F.floor(draws.uniform(F.lit(5), F.col("doc_id"), "entry") * of).cast("int")


@query(
    "operators_catalogue",
    f"""WITH c AS (SELECT * FROM (VALUES {_sql_rows(_ENTRIES)}) t(n, name, kind, dims, sev_lo, sev_hi, in_pool)),
d AS (SELECT floor({_DRAWN} * {len(_ENTRIES)})::INTEGER AS n, count(*) AS documents, sum(n_chars)::BIGINT AS characters FROM documents GROUP BY 1)
SELECT name, kind, dims, sev_lo::DOUBLE AS sev_lo, sev_hi::DOUBLE AS sev_hi, in_pool, coalesce(documents, 0) AS documents, coalesce(characters, 0) AS characters FROM c LEFT JOIN d USING (n)""",
)
def _operators(spark, sf):
    """The registry, and what a keyed draw of one operator for each document would render."""
    drawn = table(spark, sf, "documents").groupBy(_entry(len(OPERATORS)).alias("n")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").cast("long").alias("characters"))
    numbers = F.create_map(*[F.lit(x) for n, name in enumerate(OPERATORS) for x in (name, n)])
    met = operator_catalogue(spark).withColumn("n", numbers[F.col("name")]).join(drawn, "n", "left")
    return met.select("name", "kind", "dims", "sev_lo", "sev_hi", "in_pool", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "characters")])


_CONDITIONS = [tuple(s[:3]) for s in catalogue.specs()]


@query(
    "benchmark_catalogue",
    f"""WITH c AS (SELECT * FROM (VALUES {_sql_rows([(n, *s) for n, s in enumerate(_CONDITIONS)])}) t(n, name, tier, kind)),
d AS (SELECT floor({_DRAWN} * {len(_CONDITIONS)})::INTEGER AS n, count(*) AS documents FROM documents GROUP BY 1)
SELECT name, tier, kind, coalesce(documents, 0) AS documents FROM c LEFT JOIN d USING (n)""",
)
def _catalogue(spark, sf):
    """The benchmark's conditions, and how many documents draw each."""
    drawn = table(spark, sf, "documents").groupBy(_entry(len(_CONDITIONS)).alias("n")).agg(F.count(F.lit(1)).alias("documents"))
    numbers = F.create_map(*[F.lit(x) for n, s in enumerate(_CONDITIONS) for x in (s[0], n)])
    met = catalogue.build_catalog(spark).withColumn("n", numbers[F.col("name")]).join(drawn, "n", "left")
    return met.select("name", "tier", "kind", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))


_COND = "k AS (SELECT DISTINCT p_brand AS name, list_value('clean', 'mild', 'protocols', 'full')[1 + ascii(right(p_brand, 1)) % 4] AS tier FROM part)"


def _conditions(spark: SparkSession, sf: str) -> DataFrame:
    tier = F.get(F.array(*map(F.lit, catalogue.TIERS)), F.ascii(F.right("p_brand", F.lit(1))) % 4)
    return table(spark, sf, "part").select(F.col("p_brand").alias("name"), tier.alias("tier")).distinct()


@query("tier_cumulative_members", f"WITH {_COND}, o AS (SELECT * FROM (VALUES ('clean', 0), ('mild', 1), ('protocols', 2), ('full', 3)) v(t, n)) SELECT s.t AS summary_tier, k.name, k.tier FROM k JOIN o m ON m.t = k.tier JOIN o s ON s.n >= m.n WHERE k.tier <> 'clean' OR s.t = 'clean'")
def _tiers(spark, sf):
    return catalogue.cumulative_tiers(_conditions(spark, sf))


@query("trial_plan", f"WITH {_COND} SELECT s_suppkey AS \"case\", name AS condition, tier, r::INTEGER AS repeat FROM supplier, (SELECT * FROM k UNION ALL SELECT 'clean', 'clean') k, range(0, 2) x(r) WHERE name <> 'clean' OR r = 0")
def _plan(spark, sf):
    conditions = _conditions(spark, sf).union(spark.createDataFrame([("clean", "clean")], "name string, tier string"))
    return catalogue.trial_plan(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("case")), conditions, 2)


@query("trial_seed_hex", """SELECT c_custkey, substr(sha256('[2026, "' || c_name || '", "clean", ' || (c_custkey % 3)::VARCHAR || ']'), 1, 16) AS seed FROM customer""")
def _seeds(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", catalogue.trial_seed(2026, F.col("c_name"), F.lit("clean"), (F.col("c_custkey") % 3)).alias("seed"))


@query("case_subset_topk", "SELECT c_custkey, sha256('11:' || c_custkey::VARCHAR) AS subset_key FROM customer ORDER BY subset_key, c_custkey LIMIT 25")
def _subset(spark, sf):
    return catalogue.case_subset(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 25, 11)


_PAIRS = "m AS (SELECT l_orderkey, count(*) AS n, min(l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR || '_m.nii.gz') AS mask FROM lineitem WHERE l_quantity > 25 GROUP BY 1), p AS (SELECT o_orderkey::VARCHAR AS key, o_orderkey::VARCHAR || '.nii.gz' AS scan, CASE WHEN n = 1 THEN mask END AS mask, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' END AS discovery_error FROM orders LEFT JOIN m ON o_orderkey = l_orderkey)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    scans = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".nii.gz")).alias("path"))
    key = F.col("l_orderkey").cast("string")
    masks = table(spark, sf, "lineitem").filter("l_quantity > 25").select(F.concat(key, F.lit("_m")).alias("key"), F.concat(key, F.lit("/"), F.col("l_linenumber").cast("string"), F.lit("_m.nii.gz")).alias("path"))
    return listings.pair_masks(scans, masks, "_m")


@query("pair_scan_mask", f"WITH {_PAIRS} SELECT * FROM p")
def _pair(spark, sf):
    return _pairs(spark, sf)


@query("ambiguous_pairs", f"WITH {_PAIRS} SELECT coalesce(discovery_error, 'paired') AS outcome, count(*) AS n FROM p GROUP BY 1")
def _ambiguous(spark, sf):
    return _pairs(spark, sf).groupBy(F.coalesce("discovery_error", F.lit("paired")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_URL = "regexp_replace(url, '[?#].*$', '')"


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    bare = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf, "pages").select("page_id", "url", F.concat(bare, F.when(F.col("page_id") % 3 == 0, ".NII").when(F.col("page_id") % 3 == 1, ".nii.gz").otherwise("")).alias("path"))


@query("path_stem_parse", f"WITH p AS (SELECT page_id, {_URL} || CASE WHEN page_id % 3 = 0 THEN '.NII' WHEN page_id % 3 = 1 THEN '.nii.gz' ELSE '' END AS path FROM pages), n AS (SELECT page_id, regexp_extract(path, '([^/\\\\]*)$', 1) AS n FROM p) SELECT page_id, CASE WHEN page_id % 3 < 2 THEN regexp_replace(n, '(?i)\\.nii(\\.gz)?$', '') END AS stem, lower(regexp_extract(n, '(?i)(\\.nii(?:\\.gz)?)$', 1)) AS ext FROM n")
def _stems(spark, sf):
    return _paths(spark, sf).select("page_id", listings.stem(F.col("path")).alias("stem"), listings.extension(F.col("path")).alias("ext"))


@query("keyword_filter", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'example') AND NOT contains(lower(url), 'ref=') AND NOT contains(lower(url), 'm.')")
def _keywords(spark, sf):
    return listings.keyword_filter(table(spark, sf, "pages").select("page_id", "url"), "url", ["Example"], ["ref=", "m."])


@query("output_collisions", f"SELECT lower({_URL}) AS output, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1")
def _collisions(spark, sf):
    rows = table(spark, sf, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("out"))
    return listings.output_collisions(rows, "out")


@query("protected_antijoin", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT text FROM documents WHERE source = 'src1' UNION ALL SELECT text FROM benchmark) b WHERE b.text = d.text)")
def _protected(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content"))
    protected = d.filter("source = 'src1'").select("content").union(table(spark, sf, "benchmark").select(F.sha2("text", 256)))
    return listings.unprotected(d, protected, "content").select("doc_id")


_SPLIT = "h AS (SELECT DISTINCT c_custkey, sha256('5:' || c_custkey::VARCHAR) AS h FROM customer), r AS (SELECT c_custkey, row_number() OVER (ORDER BY h) AS n, count(*) OVER () AS t FROM h), c AS (SELECT *, greatest(0, least(round_even(0.2 * t, 0), t - 2)) AS nt FROM r), d AS (SELECT *, greatest(1, least(round_even(0.1 * t, 0), t - nt - 1)) AS nv FROM c), sp AS (SELECT c_custkey, CASE WHEN n <= nt THEN 'test' WHEN n <= nt + nv THEN 'val' ELSE 'train' END AS split FROM d)"


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return splits.subject_split(table(spark, sf, "customer"), "c_custkey", 0.2, 0.1, 5)


@query("subject_split", f"WITH {_SPLIT} SELECT c_custkey, split FROM sp")
def _subjects(spark, sf):
    return _customers(spark, sf)


@query("split_accounting", f"WITH {_SPLIT} SELECT split, count(*) AS acquisitions, count(DISTINCT o_custkey) AS subjects FROM orders JOIN sp ON o_custkey = c_custkey GROUP BY split")
def _accounting(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey").join(_customers(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("acquisitions"), F.countDistinct("o_custkey").alias("subjects"))


@query("split_overlap_check", "SELECT DISTINCT a.o_custkey FROM orders a JOIN orders b USING (o_custkey) WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'P'")
def _overlap(spark, sf):
    o = table(spark, sf, "orders")
    return splits.split_overlap(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), "o_custkey")


_PART8 = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * k}, 8))::HUGEINT) AS s{k}" for k in range(8))
@query("split_fingerprint", f"WITH {_SPLIT}, h AS (SELECT split, sha256(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus)) AS h FROM orders JOIN sp ON o_custkey = c_custkey), g AS (SELECT split, count(*) AS members, {_PART8} FROM h GROUP BY split) SELECT split, members, sha256(concat_ws(':', members::VARCHAR, {', '.join(f's{k}::VARCHAR' for k in range(8))})) AS fingerprint FROM g".replace(", h AS (SELECT split", ", hh AS (SELECT split").replace("FROM h GROUP BY split", "FROM hh GROUP BY split"))  # noqa: E302
def _fingerprint(spark, sf):
    rows = table(spark, sf, "orders").join(_customers(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    return splits.fingerprint(rows, ["split"], ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("copy_collapse", "SELECT lang, n_chars, min(doc_id) AS doc_id, count(*) AS copies, min(text) = max(text) AS identical FROM documents GROUP BY 1, 2")
def _copies(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("content"))
    return splits.copy_collapse(d, ["lang", "n_chars"], "content", "doc_id")


@query("preflight_abort", "SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars < 1000) AS bad, CASE WHEN count(*) = count(*) FILTER (WHERE n_chars < 1000) OR 2 * count(*) FILTER (WHERE n_chars < 1000) > count(*) THEN 'abort' ELSE 'go' END AS verdict FROM documents GROUP BY source")
def _preflight(spark, sf):
    return splits.preflight(table(spark, sf, "documents").select("source", "n_chars"), F.col("n_chars") >= 1000, "source")


@query("grid_match", "SELECT vec_id, list_bool_and(list_transform(range(1, 17), lambda i: abs(embedding[i]::DOUBLE - embedding[i + 16]::DOUBLE) <= 2.5)) AS same FROM embeddings")
def _grid(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    shape = F.array(F.lit(4))
    return e.select("vec_id", splits.same_grid(shape, F.slice("e", 1, 16), shape, F.slice("e", 17, 16), 2.5).alias("same"))


@query("subject_ids", "SELECT c_custkey, lower(CASE WHEN c_custkey % 4 = 0 THEN 'X' || c_custkey::VARCHAR WHEN c_custkey % 4 = 1 THEN 'S' || c_custkey::VARCHAR WHEN c_custkey % 4 = 2 THEN 'A' || lpad(c_custkey::VARCHAR, 8, '0') END) AS subject FROM customer")
def _subject_ids(spark, sf):
    k = F.col("c_custkey").cast("string")
    kind = F.col("c_custkey") % 4
    path = F.when(kind == 1, F.concat(F.lit("/data/sub-S"), k, F.lit("_T1w.nii.gz"))).when(kind == 2, F.concat(F.lit("/data/A"), F.lpad(k, 8, "0"), F.lit("_scan.nii.gz"))).otherwise(F.lit("/data/other.nii.gz"))
    explicit = F.when(kind == 0, F.concat(F.lit("sub-X"), k))
    return table(spark, sf, "customer").select("c_custkey", listings.subject_id(path, explicit).alias("subject"))


# recovery and history

_RETRY = f"{_TRIALS}, n AS (SELECT \"case\", condition, repeat, CASE WHEN event_id % 20 = 0 THEN 'ok' ELSE 'unchanged' END AS status, score * 0.9 AS score FROM t WHERE status = 'failed'), g AS (SELECT t.\"case\", t.condition, t.repeat, coalesce(n.status, t.status) AS status, coalesce(n.score, t.score) AS score, CASE WHEN n.status IS NULL THEN 'original' ELSE 'retried' END AS origin, t.status AS was FROM t LEFT JOIN n USING (\"case\", condition, repeat))"
_KEY = ["case", "condition", "repeat"]


def _merged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = _trials(spark, sf)
    again = t.filter("status = 'failed'").select(*_KEY, F.when(F.col("event_id") % 20 == 0, "ok").otherwise("unchanged").alias("status"), (F.col("score") * 0.9).alias("score"))
    return t, recovery.merge(t, again, _KEY, ["status", "score"])


@query("recovery_merge", f"WITH {_RETRY} SELECT \"case\", condition, repeat::INTEGER AS repeat, status, round(score, 6) + 0.0 AS score, origin FROM g")
def _merge(spark, sf):
    return rounded(_merged(spark, sf)[1], "score")


@query("recovery_accounting", f"WITH {_RETRY} SELECT count(*) FILTER (WHERE origin = 'retried') AS retried, count(*) FILTER (WHERE was = 'failed' AND status = 'ok') AS recovered, count(*) FILTER (WHERE was = 'failed' AND status = 'unchanged') AS failed_to_unchanged, count(*) FILTER (WHERE origin = 'original' AND status = 'ok') AS retained_ok, count(*) FILTER (WHERE origin = 'original' AND status = 'unchanged') AS retained_unchanged FROM g")
def _recovered(spark, sf):
    return recovery.accounting(*_merged(spark, sf), _KEY)


@query("plan_problems", f"WITH {_TRIALS}, p AS (SELECT \"case\", condition, r AS repeat FROM (SELECT DISTINCT \"case\", condition FROM t), range(0, 10) x(r)), n AS (SELECT \"case\", condition, repeat, sum(p) AS p, sum(r) AS r FROM (SELECT *, 1 AS p, 0 AS r FROM p UNION ALL SELECT \"case\", condition, repeat, 0, 1 FROM t) GROUP BY 1, 2, 3) SELECT \"case\", condition, repeat::INTEGER AS repeat, CASE WHEN p = 0 THEN 'outside' WHEN r > 1 THEN 'duplicate' ELSE 'missing' END AS problem FROM n WHERE p = 0 OR r > 1 OR r = 0")
def _problems(spark, sf):
    t = _trials(spark, sf)
    plan = t.select("case", "condition").distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return recovery.problems(plan, t, _KEY, parts_for(table(spark, sf, "events")))


@query("backoff_valid", "WITH b AS (SELECT user_id, ts, event_id, (4 >> (row_number() OVER w - 1)::INTEGER % 3)::INTEGER AS before, CASE WHEN event_id % 50 = 0 THEN 1 ELSE (2 >> (row_number() OVER w - 1)::INTEGER % 3) END::INTEGER AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), d AS (SELECT user_id, ts::DATE::VARCHAR AS day, before, after, lag(after) OVER v AS la FROM b WINDOW v AS (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id)) SELECT user_id, day, min(CASE WHEN after * 2 = before AND (la IS NULL OR la = before) THEN 1 ELSE 0 END) = 1 AS valid, count(*) AS steps FROM d GROUP BY 1, 2")
def _backoff(spark, sf):
    e = table(spark, sf, "events")
    at = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1) % 3
    four, two = F.get(F.array(F.lit(4), F.lit(2), F.lit(1)), at), F.get(F.array(F.lit(2), F.lit(1), F.lit(0)), at)
    steps = e.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id", four.alias("before"), F.when(F.col("event_id") % 50 == 0, 1).otherwise(two).alias("after"))
    return recovery.backoff_valid(steps, ["user_id", "day"], ["ts", "event_id"], "before", "after")


@query("attempt_sequence", "WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) SELECT conv_id, min(CASE WHEN n = turn + 1 THEN 1 ELSE 0 END) = 1 AS valid, count(*) AS attempts FROM n GROUP BY conv_id")
def _attempts(spark, sf):
    c = table(spark, sf, "conversations").withColumn("number", F.col("turn") + 1)
    return recovery.attempts_valid(c, ["conv_id"], "number", ["turn", "role", "text"])


@query("history_contiguous", "SELECT conv_id, count(*) AS n, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY conv_id")
def _history(spark, sf):
    return recovery.contiguous(table(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query("best_so_far", "WITH m AS (SELECT user_id, max(value) AS b FROM events GROUP BY 1) SELECT e.user_id, round(b, 6) + 0.0 AS best_score, min(event_id) AS best_index FROM events e JOIN m ON e.user_id = m.user_id AND e.value = m.b GROUP BY 1, 2")
def _best(spark, sf):
    return rounded(recovery.best(table(spark, sf, "events"), ["user_id"], "value", "event_id"), "best_score")


@query("constant_settings", "SELECT l_orderkey, nullif(concat_ws(',', CASE WHEN min(l_returnflag) <> max(l_returnflag) THEN 'l_returnflag' END, CASE WHEN min(l_linestatus) <> max(l_linestatus) THEN 'l_linestatus' END), '') AS varied FROM lineitem GROUP BY 1")
def _settings(spark, sf):
    return recovery.constant_settings(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


# routing


def _choice_sql(draw: str, weights: dict[str, float]) -> str:
    total, running, out = math.fsum(weights.values()), 0.0, "CASE"
    for name, w in list(weights.items())[:-1]:
        running += w / total
        out += f" WHEN {draw} < {running!r} THEN '{name}'"
    return f"{out} ELSE '{list(weights)[-1]}' END" if len(weights) > 1 else f"'{next(iter(weights))}'"


_DRAWS = f"u AS (SELECT c_custkey, {_u(chr(39) + '3' + chr(39), 'c_custkey', chr(39) + 'route' + chr(39))} AS u FROM customer)"


def _draws(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", draws.uniform(3, F.col("c_custkey"), "route").alias("u"))


_MIXED = routing.Policy(mixed_fraction=0.3, conditional=(("superset", 0.2), ("posterior_fossa", 0.25)), target_style=0.1)


@query("route_default", f"WITH {_DRAWS} SELECT c_custkey, {_choice_sql('u', routing.DEFAULT)} AS route FROM u")
def _route(spark, sf):
    return _draws(spark, sf).select("c_custkey", routing.route_default(F.col("u")).alias("route"))


@query("route_mixed", f"WITH {_DRAWS} SELECT c_custkey, CASE WHEN u < 0.3 THEN 'mp2rage' ELSE {_choice_sql('((u - 0.3) / 0.7)', routing.MIXED_REST)} END AS route, {_choice_sql('u', {'superset': 0.2, 'posterior_fossa': 0.25, 'target_style': 0.1, 'clean_anchor': 0.1, 'ordinary': 0.35})} AS inner_route FROM u")
def _route_mixed(spark, sf):
    return _draws(spark, sf).select("c_custkey", routing.route(F.col("u"), _MIXED).alias("route"), routing.route_mp2rage(F.col("u"), _MIXED).alias("inner_route"))


@query("hard_tail_gate", f"WITH {_DRAWS} SELECT c_custkey, {_choice_sql('u', {'hard_tail': 0.05, 'dedicated': 0.95 * 0.3, 'other': 0.95 * 0.7})} AS gate FROM u")
def _gate(spark, sf):
    return _draws(spark, sf).select("c_custkey", routing.hard_tail_gate(F.col("u"), 0.05, 0.3).alias("gate"))


@query("profile_choice", f"WITH {_DRAWS} SELECT c_custkey, {_choice_sql('u', routing.POSTERIOR_PHENOTYPES)} AS phenotype, {_choice_sql('u', {k: 1.0 for k in routing.HARD_PROFILES})} AS profile FROM u")
def _profiles(spark, sf):
    return _draws(spark, sf).select("c_custkey", draws.choice(F.col("u"), routing.POSTERIOR_PHENOTYPES).alias("phenotype"), draws.choice(F.col("u"), {k: 1.0 for k in routing.HARD_PROFILES}).alias("profile"))


@query("curriculum_ramp", "SELECT event_id, round(p, 6) + 0.0 AS progress, ceil(p * 2)::INTEGER AS steps FROM (SELECT event_id, CASE WHEN event_id % 40 < 5 THEN 0.0 ELSE least(1.0, (event_id % 40 - 4) / 20.0) END AS p FROM events)")
def _ramp(spark, sf):
    progress, steps = routing.curriculum_ramp(F.col("event_id") % 40)
    return table(spark, sf, "events").select("event_id", r6(progress).alias("progress"), steps.alias("steps"))


@query("lr_schedule", f"SELECT event_id, round(CASE WHEN s < 100 THEN 0.01 * (0.1 + 0.9 * s / 100.0) ELSE 0.5 * 0.01 * (1 + cos({math.pi!r} * least(1.0, (s - 100) / 900.0))) END, 6) + 0.0 AS rate FROM (SELECT event_id, event_id % 1200 AS s FROM events)")
def _rate(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(routing.lr_schedule(F.col("event_id") % 1200, 100, 1000, 0.01)).alias("rate"))


from . import queries_blocks, queries_measures, queries_more, queries_volumes  # noqa: E402, F401  (they register their queries)
