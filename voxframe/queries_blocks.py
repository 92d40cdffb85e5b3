"""Queries on volumes that span rows (eight vectors are the planes of one volume of 8 x 8 x 8, whose voxels are rows), and whole sample runs."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fourier
from .functions.staging import shared_dir
from .functions.tasks import spread
from .operators import OPERATORS, blocks, components, style
from .operators.conform import conform
from .plans import lags, samples
from .plans import specifications as specs
from .plans.routing import DEFAULT, STRONG_DIMMERS
from .queries import _NORMAL, _VOX, SEED, _choice_sql, _u, query, rounded, table
from .queries_volumes import _gauss, _three
from .sources.records import next_readable
from .sources.volumes import embedding_volumes
from .streaming import runs

#: Blocks of four voxels a side, so that volumes span eight blocks.
BLOCK = 4
SPACING = (1.0, 0.7, 2.5)
_MASK = 0.13


def volume_voxels(spark: SparkSession, sf: str) -> DataFrame:
    """(case_id, i, j, k, value, mask): a vector's numbers are a plane, in rows of eight."""
    rows = spread(table(spark, sf, "embeddings")).select("vec_id", F.posexplode("embedding").alias("at", "value"))
    place = [F.floor(F.col("vec_id") / 8).alias("case_id"), (F.col("vec_id") % 8).cast("int").alias("i"), F.floor(F.col("at") / 8).cast("int").alias("j"), (F.col("at") % 8).alias("k")]
    return rows.select(*place, F.col("value").cast("double").alias("value")).withColumn("mask", F.col("value") > _MASK)


_VOXELS = f"""vox AS (
  SELECT vec_id // 8 AS case_id, (vec_id % 8)::INTEGER AS i, ((t - 1) // 8)::INTEGER AS j, ((t - 1) % 8)::INTEGER AS k, embedding[t]::DOUBLE AS value, embedding[t]::DOUBLE > {_MASK} AS mask
  FROM embeddings, range(1, 65) r(t))"""


def _differences(field: str, axis: str) -> str:
    others = ", ".join(a for a in "ijk" if a != axis)
    w = f"OVER (PARTITION BY case_id, {others} ORDER BY {axis})"
    after, before = f"lead({field}) {w}", f"lag({field}) {w}"
    return f"CASE WHEN {after} IS NOT NULL AND {before} IS NOT NULL THEN ({after} - {before}) / 2 WHEN {after} IS NOT NULL THEN {after} - {field} ELSE {field} - {before} END"


_FIELDS = ("di", "dj", "dk")
_G = ", ".join(f"{_differences(f, a)} + {int(f == 'd' + a)} AS {f}_{a}" for f in _FIELDS for a in "ijk")


@query(
    "block_jacobian_minimum",
    f"""WITH {_VOXELS}, field AS (
  SELECT a.case_id, a.i, a.j, a.k, 1.5 * a.value AS di, 1.5 * b.value AS dj, 1.5 * (a.value - b.value) AS dk
  FROM vox a JOIN vox b ON a.case_id = b.case_id AND a.i = b.i AND a.j = b.k AND a.k = b.j),
g AS (SELECT case_id, {_G} FROM field),
d AS (SELECT case_id, di_i * (dj_j * dk_k - dj_k * dk_j) - di_j * (dj_i * dk_k - dj_k * dk_i) + di_k * (dj_i * dk_j - dj_j * dk_i) AS d FROM g)
SELECT case_id, round(CASE WHEN bool_or(d IS NULL) THEN '-inf'::DOUBLE ELSE min(d) END, 6) + 0.0 AS least FROM d GROUP BY case_id""",
)
def _jacobian(spark: SparkSession, sf: str) -> DataFrame:
    """Of the warp by the values, their transpose and the difference, one and a half voxels long."""
    own = volume_voxels(spark, sf).select("case_id", "i", "j", "k", "value")
    turned = own.select("case_id", "i", F.col("k").alias("j"), F.col("j").alias("k"), F.col("value").alias("turned"))
    field = own.join(turned.hint("merge"), ["case_id", "i", "j", "k"]).select("case_id", "i", "j", "k", (1.5 * F.col("value")).alias("di"), (1.5 * F.col("turned")).alias("dj"), (1.5 * (F.col("value") - F.col("turned"))).alias("dk"))
    return rounded(blocks.jacobian_minimum(field, BLOCK), "least")


@query(
    "block_boundary_band",
    f"""WITH {_VOXELS}
SELECT p.case_id, p.i, p.j, p.k, bool_or(q.mask) AND bool_or(NOT q.mask) AS band
FROM vox p JOIN vox q ON p.case_id = q.case_id AND abs(p.i - q.i) <= 1 AND abs(p.j - q.j) <= 1 AND abs(p.k - q.k) <= 1 GROUP BY ALL""",
)
def _band(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.boundary_band(volume_voxels(spark, sf), radius=1, size=BLOCK)


_SQUARE = " + ".join(f"power((p.{a} - q.{a}) * {s!r}, 2)" for a, s in zip("ijk", SPACING, strict=True))


@query(
    "block_signed_distance",
    f"""WITH {_VOXELS}
SELECT p.case_id, p.i, p.j, p.k, p.mask,
  round(CASE WHEN count(*) FILTER (q.mask) = 0 OR count(*) FILTER (NOT q.mask) = 0 THEN 0.0
    WHEN p.mask THEN -sqrt(min({_SQUARE}) FILTER (NOT q.mask)) ELSE sqrt(min({_SQUARE}) FILTER (q.mask)) END, 6) + 0.0 AS distance
FROM vox p JOIN vox q ON p.case_id = q.case_id GROUP BY p.case_id, p.i, p.j, p.k, p.mask""",
)
def _distance(spark: SparkSession, sf: str) -> DataFrame:
    """With unequal spacing, by lower envelopes of lines."""
    return rounded(blocks.signed_distance(volume_voxels(spark, sf), SPACING), "distance")


_TOUCH = "a.case_id = b.case_id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1"
_PARTS = f"""inside AS (SELECT case_id, i, j, k, (i::BIGINT * 2097152 + j) * 2097152 + k AS node FROM vox WHERE mask),
touch AS (SELECT a.case_id, a.node AS x, b.node AS y FROM inside a JOIN inside b ON {_TOUCH}),
reach(case_id, node, root) AS (SELECT case_id, node, node FROM inside UNION SELECT r.case_id, t.y, r.root FROM reach r JOIN touch t ON t.case_id = r.case_id AND t.x = r.node),
rooted AS (SELECT case_id, node, min(root) AS component FROM reach GROUP BY ALL),
sizes AS (SELECT case_id, component, count(*) AS size FROM rooted GROUP BY ALL),
judged AS (SELECT *, size >= 0.05 * max(size) OVER (PARTITION BY case_id) AS kept, size >= 0.02 * max(size) OVER (PARTITION BY case_id) AS large FROM sizes)"""


@query("block_component_sizes", f"WITH RECURSIVE {_VOXELS}, {_PARTS} SELECT case_id, component, size, kept, NOT kept AND large AS noted FROM judged")
def _components(spark: SparkSession, sf: str) -> DataFrame:
    return components.component_sizes(volume_voxels(spark, sf))


@query(
    "block_cleaned_mask",
    f"""WITH RECURSIVE {_VOXELS}, {_PARTS},
main AS (
  SELECT v.case_id, v.i, v.j, v.k, coalesce(j.kept, false) AS inside, (v.i::BIGINT * 2097152 + v.j) * 2097152 + v.k AS node FROM vox v
  LEFT JOIN rooted r ON r.case_id = v.case_id AND r.node = (v.i::BIGINT * 2097152 + v.j) * 2097152 + v.k LEFT JOIN judged j ON j.case_id = r.case_id AND j.component = r.component),
ends AS (SELECT case_id, max(i) AS mi, max(j) AS mj, max(k) AS mk FROM vox GROUP BY case_id),
outside(case_id, i, j, k) AS (
  SELECT case_id, i, j, k FROM main JOIN ends USING (case_id) WHERE NOT inside AND (i IN (0, mi) OR j IN (0, mj) OR k IN (0, mk))
  UNION SELECT m.case_id, m.i, m.j, m.k FROM outside o JOIN main m ON m.case_id = o.case_id AND abs(m.i - o.i) + abs(m.j - o.j) + abs(m.k - o.k) = 1 AND NOT m.inside),
notes AS (SELECT case_id, bool_or(NOT kept AND large) AS noted FROM judged GROUP BY case_id)
SELECT m.case_id, m.i, m.j, m.k, o.case_id IS NULL AS mask, coalesce(noted, false) AS noted
FROM main m LEFT JOIN outside o ON o.case_id = m.case_id AND o.i = m.i AND o.j = m.j AND o.k = m.k LEFT JOIN notes n ON n.case_id = m.case_id""",
)
def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Small components dropped, holes filled."""
    return components.cleaned(volume_voxels(spark, sf))


def _sums(values: str, n: int) -> str:
    angle = f"2 * pi() * k * t / {n}"
    return f"""SELECT vec_id, {n} AS n, k::INTEGER AS k, round(sum({values}[t + 1] * cos({angle})), 6) + 0.0 AS re, round(-sum({values}[t + 1] * sin({angle})), 6) + 0.0 AS im
FROM lines, range({n}) f(k), range({n}) s(t) GROUP BY ALL"""


@query(
    "line_spectra",
    f"""WITH lines AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_transform(range(1, 64), lambda i: embedding[i + 1]::DOUBLE - embedding[i]::DOUBLE) AS d FROM embeddings)
{_sums("v", 64)} UNION ALL {_sums("d", 63)}""",
)
def _spectra(spark: SparkSession, sf: str) -> DataFrame:
    """Of each vector, and of the 63 differences of its neighbours."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    d = F.zip_with(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, F.size(v) - 1), lambda b, a: b - a)
    rows = spread(table(spark, sf, "embeddings")).select("vec_id", F.explode(F.array(v, d)).alias("v"))
    each = fourier.line_spectra(rows, "v").select("vec_id", F.size("v").alias("n"), F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
    return rounded(each.select("vec_id", "n", "k", "z.re", "z.im"), "re", "im")


# a whole sample run, whose kinds SQL can tell where no stage moves the mask

_STILL = samples.Mix(morphology=0.0, pose=0.0, artifacts=0.5)
_KEY = lambda *d: _u(f"'{SEED}'", "vec_id", "'sample'", *[f"'{x}'" for x in d])
_POOL = [n for n, o in OPERATORS.items() if o.pool]
_TABLE = ", ".join(f"('{n}', {n in STRONG_DIMMERS})" for n in _POOL)


@query(
    "sample_run",
    f"""WITH {_NORMAL},
plan AS (
  SELECT vec_id, v, {_choice_sql(_KEY("route"), DEFAULT)} AS route, {_choice_sql(_KEY("protocol"), {k: 1.0 for k in samples.STANDARD})} AS protocol,
    {_KEY("resolution")} < 0.6 AS coarse, {_KEY("artifact")} < 0.5 AS artifact, {_u(f"'{SEED}'", "vec_id", "'count'")} < 0.5 AS single FROM vol),
pool AS (SELECT vec_id, name, dim, row_number() OVER (PARTITION BY vec_id ORDER BY {_u(f"'{SEED}'", "vec_id", "name")}, name) AS place
  FROM plan, (VALUES {_TABLE}) t(name, dim) WHERE NOT (coarse AND name = 'anisotropy')),
pick AS (SELECT a.vec_id, a.name AS first, arg_min(b.name, b.place) AS second FROM pool a JOIN pool b ON a.vec_id = b.vec_id AND b.place > 1 AND NOT (a.dim AND b.dim) WHERE a.place = 1 GROUP BY ALL),
kinds AS (
  SELECT vec_id, v, route, CASE WHEN vec_id % 5 = 0 THEN 'clean_geometry_fallback' ELSE
    CASE route WHEN 'standard' THEN protocol WHEN 'label_synthesis' THEN 'synthetic' ELSE route END
    || CASE WHEN artifact AND route IN ('benign', 'label_synthesis') THEN '+' || first || CASE WHEN single THEN '' ELSE '+' || second END ELSE '' END END AS kind
  FROM plan JOIN pick USING (vec_id))
SELECT vec_id, route, kind, CASE WHEN kind LIKE 'clean%' THEN round(list_sum(list_transform(range(1, 65), lambda i: i * v[i])), 6) + 0.0 END AS source_sum FROM kinds""",
)
def _sample_run(spark: SparkSession, sf: str) -> DataFrame:
    """Masks in the middle, or of every fifth case across the whole volume, which the guard refuses; source_sum weighs the voxels of pairs that are the source's."""
    middle = F.array(*[F.lit(all(1 <= c <= 2 for c in (n // 16, n // 4 % 4, n % 4))) for n in range(64)])
    cases = embedding_volumes(spark, sf).withColumn("mask", F.when(F.col("case_id") % 5 == 0, F.array_repeat(F.lit(True), 64)).otherwise(middle))
    made = samples.draw(cases, SEED, _STILL)
    weighed = F.aggregate(F.transform("voxels", lambda x, at: x * (at + 1)), F.lit(0.0), lambda s, x: s + x)
    return rounded(made.select(F.col("case_id").alias("vec_id"), "route", "kind", F.when(F.col("kind").startswith("clean"), weighed).alias("source_sum")), "source_sum")


# lags

_TAPS = [math.exp(-0.5 * (d / lags.SIGMA) ** 2) for d in range(-2, 3)]
_RESPONSE = " + ".join(f"{t / sum(_TAPS)!r} * cos({2 * math.pi * d!r} * f)" for d, t in zip(range(-2, 3), _TAPS, strict=True))
_COS = [f"cos({2 * math.pi * lag!r} * {'xyz'[axis]}.f)" for axis, lag in lags.LAGS]
_MEANS = ", ".join(f"avg(w * c{k}) AS l{k}, avg(2 * w * c{k}) AS v{k}, " + ", ".join(f"avg(2 * w * c{k} * c{j}) AS b{k}{j}" for j in range(6)) for k in range(6))
_WANTED = [f"least(greatest(embedding[{k + 1}]::DOUBLE, -{lags.WANTED}), {lags.WANTED})" for k in range(6)]
_EQUATIONS = "[" + ", ".join("[" + ", ".join([f"b{k}{j} - {_WANTED[k]} * v{j}" for j in range(6)] + [f"{_WANTED[k]} * variance - l{k}"]) + "]" for k in range(6)) + "]"


@query(
    "lag_calibration",
    f"""WITH RECURSIVE line AS (SELECT f, {_RESPONSE} AS r FROM (SELECT CASE WHEN 2 * n < 64 THEN n ELSE n - 64 END / 64.0::DOUBLE AS f FROM range(64) t(n))),
space AS (SELECT power(1 - x.r * y.r * z.r, 2) AS w, {", ".join(f"{c} AS c{k}" for k, c in enumerate(_COS))} FROM line x, line y, line z),
means AS (SELECT avg(w) AS variance, {_MEANS} FROM space),
reduced(vec_id, k, m) AS (
  SELECT vec_id, 0, {_EQUATIONS} FROM embeddings, means
  UNION ALL
  SELECT vec_id, k + 1, list_transform(m, lambda row, r: CASE WHEN r = k + 1 THEN list_transform(row, lambda x: x / row[k + 1]) ELSE list_transform(row, lambda x, c: x - row[k + 1] * m[k + 1][c] / m[k + 1][k + 1]) END)
  FROM reduced WHERE k < 6),
solved AS (SELECT vec_id, list_transform(m, lambda row: least(greatest(row[7], -{lags.RAW}), {lags.RAW})) AS cut FROM reduced WHERE k = 6),
scaled AS (SELECT vec_id, list_transform(cut, lambda x: x * least(1.0, {lags.BOUND} / greatest(2 * list_sum(list_transform(cut, lambda y: abs(y))), 1e-300))) AS raw FROM solved)
SELECT vec_id, k::INTEGER AS k, round(raw[k + 1], 6) + 0.0 AS raw,
  round((CASE k {" ".join(f"WHEN {k} THEN l{k} + " + " + ".join(f"b{k}{j} * raw[{j + 1}]" for j in range(6)) for k in range(6))} END) / (variance + {" + ".join(f"v{j} * raw[{j + 1}]" for j in range(6))}), 6) + 0.0 AS achieved, true AS solved
FROM scaled, means, range(6) t(k)""",
)
def _lags(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted lags are a vector's first six numbers; the elimination in SQL has no pivots."""
    cases = table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double")).alias("lags"))
    made = lags.calibrated(cases)
    each = made.select("vec_id", (F.col("residual") < 1e-9).alias("solved"), F.posexplode(F.arrays_zip("raw", "achieved")).alias("k", "z"))
    return rounded(each.select("vec_id", "k", "z.raw", "z.achieved", "solved"), "raw", "achieved")


@query(
    "next_readable_record",
    """WITH r AS (SELECT doc_id, n_chars % 7 = 3 AND doc_id % 500 > 130 AS readable FROM documents)
SELECT doc_id, readable, coalesce(min(CASE WHEN readable THEN doc_id END) OVER (ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), (SELECT min(doc_id) FROM r WHERE readable)) AS stand_in FROM r""",
)
def _next_readable(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of records that can't be read reach across buckets of 64."""
    rows = table(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 7 == 3) & (F.col("doc_id") % 500 > 130)).alias("readable"))
    return next_readable(rows, "doc_id", size=64)


# state over a stream

_SPAN = 86_400


@query(
    "run_states",
    f"""WITH e AS (SELECT event_id, user_id, ts, event_id % 7 = 0 AS oom, epoch_us(ts) AS us FROM events),
s AS (SELECT *, (us - min(us) OVER (PARTITION BY user_id)) // {_SPAN * 10**6} AS span FROM e)
SELECT event_id, user_id::VARCHAR AS run,
  greatest(1, floor(16 / power(2.0, coalesce(count(*) FILTER (oom) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::INTEGER AS batch_size,
  row_number() OVER (PARTITION BY user_id, span ORDER BY ts, event_id) = 1 AS report FROM s""",
)
def _run_states(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of two files; the query over the first is stopped, and one over both goes on from its checkpoint."""
    events = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("run"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 7 == 0).alias("oom"))
    middle = events.agg(((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))) / 2).cast("long")).first()[0]
    at = f"{shared_dir(spark)}/run-states-{uuid.uuid4().hex}"
    for half in (F.unix_micros("ts") <= middle, F.unix_micros("ts") > middle):
        events.filter(half).write.mode("append").parquet(f"{at}/source")
        stream = spark.readStream.schema(events.schema).parquet(f"{at}/source")
        runs.start(runs.run_states(stream, 16, _SPAN, 100 * _SPAN), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(runs.RESULT).parquet(f"{at}/out").filter("event_id IS NOT NULL").select("event_id", "run", "batch_size", "report")


# conforming

_OUT, _MM = (7, 6, 5), 1.3
#: Of even and odd cases: the affine's 16 numbers. The second turns the axes and runs two of them the other way.
_AFFINES = ([1.0, 0, 0, -3, 0, 1.5, 0, 2, 0, 0, 0.8, 5, 0, 0, 0, 1], [0, 0, -0.9, 4, 1.2, 0, 0, -2, 0, -2.0, 0, 7, 0, 0, 0, 1.0])
#: The same by hand: of each target axis the source's, whether it is reversed, and its spacing.
_BY_HAND = (((0, False, 1.0), (1, False, 1.5), (2, False, 0.8)), ((2, True, 0.9), (0, False, 1.2), (1, True, 2.0)))


def _spline_weights(n: int, size: int, scale: float, flip: bool) -> list[list[float]]:
    """What each of n voxels adds to each place of a target line: basis functions times the inverse of their matrix at the voxels, by plain elimination."""
    basis = lambda t: (4 - 6 * t * t + 3 * abs(t) ** 3) / 6 if abs(t) < 1 else max(0.0, 2 - abs(t)) ** 3 / 6
    mirror = lambda i: min(i % (2 * n - 2), 2 * n - 2 - i % (2 * n - 2))

    def row(p: float) -> list[float]:
        out = [0.0] * n
        for i in range(math.floor(p) - 1, math.floor(p) + 3):
            out[mirror(i)] += basis(p - i)
        return out

    m = [row(float(k)) + [float(k == j) for j in range(n)] for k in range(n)]
    for k in range(n):
        m[k] = [x / m[k][k] for x in m[k]]
        for r in range(n):
            if r != k:
                m[r] = [x - m[r][k] * y for x, y in zip(m[r], m[k], strict=True)]
    out = []
    for o in range(size):
        p = (n - 1) // 2 + (o - (size - 1) // 2) * scale
        p = n - 1 - p if flip else p
        out.append([sum(w * m[i][n + j] for i, w in enumerate(row(p))) for j in range(n)] if 0 <= p <= n - 1 else [0.0] * n)
    return out


def _weights_sql() -> str:
    """(odd, planes, world, source place, target place, weight, nearest) of all lines that there are."""
    rows = []
    for odd, axes in enumerate(_BY_HAND):
        for planes in (4, 8):
            for world, (source, flip, spacing) in enumerate(axes):
                n = planes if source == 0 else 8
                for o, line in enumerate(_spline_weights(n, _OUT[world], _MM / spacing, flip)):
                    p = (n - 1) // 2 + (o - (_OUT[world] - 1) // 2) * _MM / spacing
                    p = n - 1 - p if flip else p
                    rows += [f"({odd}, {planes}, {world}, {j}, {o}, {w!r}, {0 <= p <= n - 1 and math.floor(p + 0.5) == j})" for j, w in enumerate(line)]
    return ", ".join(rows)


@query(
    "conformed_volumes",
    f"""WITH {_VOXELS},
w AS (SELECT * FROM (VALUES {_weights_sql()}) t(odd, planes, world, j, o, w, near)),
sized AS (SELECT *, max(i) OVER (PARTITION BY case_id) + 1 AS planes, case_id % 2 AS odd FROM vox),
turned AS (SELECT *, CASE odd WHEN 0 THEN i ELSE k END AS a, CASE odd WHEN 0 THEN j ELSE i END AS b, CASE odd WHEN 0 THEN k ELSE j END AS c FROM sized)
SELECT case_id, x.o AS i, y.o AS j, z.o AS k, round(sum(value * x.w * y.w * z.w), 6) + 0.0 AS value, bool_or(mask AND x.near AND y.near AND z.near) AS mask
FROM turned t JOIN w x ON x.odd = t.odd AND x.planes = t.planes AND x.world = 0 AND x.j = a JOIN w y ON y.odd = t.odd AND y.planes = t.planes AND y.world = 1 AND y.j = b
  JOIN w z ON z.odd = t.odd AND z.planes = t.planes AND z.world = 2 AND z.j = c GROUP BY ALL""",
)
def _conformed(spark: SparkSession, sf: str) -> DataFrame:
    """On a grid of 7 x 6 x 5 voxels of 1.3 mm, from grids of unequal spacing, every other one turned and reversed."""
    voxels = volume_voxels(spark, sf)
    affine = F.when(F.col("case_id") % 2 == 0, F.array(*[F.lit(float(x)) for x in _AFFINES[0]])).otherwise(F.array(*[F.lit(float(x)) for x in _AFFINES[1]]))
    grids = voxels.select("case_id").distinct().withColumn("affine", affine)
    return rounded(conform(voxels, grids, _OUT, _MM), "value")


# a step towards a style

_LABEL_SHARE = 0.06


def _edge(field: str, axis: str) -> str:
    others = ", ".join(x for x in "abc" if x != axis)
    w = f"OVER (PARTITION BY vec_id, t, {others} ORDER BY {axis})"
    after, before = f"lead({field}) {w}", f"lag({field}) {w}"
    return f"(coalesce({after}, {field}) - coalesce({before}, {field})) / (CASE WHEN {after} IS NULL OR {before} IS NULL THEN 1 ELSE 2 END)"


_SMOOTH = _three(*[_gauss(style.HIGHPASS_SIGMA)] * 3)


@query(
    "style_search",
    f"""WITH {_VOX},
cand AS (SELECT vec_id, idx, a, b, c, x, (1 - w) * power(x, 0.8) + w * v[64 - idx] AS y FROM (SELECT *, {_LABEL_SHARE} * label AS w FROM vox)),
trial AS (SELECT vec_id, power(2.0, -k) AS t, idx, a, b, c, x, CASE WHEN x = 0 THEN x ELSE least(greatest(x + power(2.0, -k) * (y - x), 0.0), 1.0) END AS z FROM cand, range(8) r(k)),
edges AS (SELECT vec_id, t, {", ".join(f"{_edge(f, a)} AS {f}{a}" for f in "xz" for a in "abc")} FROM trial),
sized AS (SELECT vec_id, t, sqrt(xa*xa + xb*xb + xc*xc) AS mx, sqrt(za*za + zb*zb + zc*zc) AS mz, xa*za + xb*zb + xc*zc AS dot FROM edges),
bars AS (SELECT vec_id, t, quantile_cont(mx, 0.6) AS bar FROM sized GROUP BY ALL),
aligned AS (
  SELECT vec_id, t, sum(greatest(mx - bar, 0.0) * dot / greatest(mx * mz, 1e-10)) / sum(greatest(mx - bar, 0.0)) AS alignment FROM sized JOIN bars USING (vec_id, t) GROUP BY ALL),
low AS (SELECT p.vec_id, p.t, p.idx, any_value(p.x) - {_SMOOTH} AS hx, any_value(p.z) - {_SMOOTH.replace("q.x", "q.z")} AS hz
  FROM trial p JOIN trial q ON p.vec_id = q.vec_id AND p.t = q.t GROUP BY p.vec_id, p.t, p.idx, p.a, p.b, p.c),
high AS (SELECT vec_id, t, corr(hx, hz) AS correlation FROM low GROUP BY ALL),
zeros AS (SELECT vec_id, t, count(*) FILTER (z = 0 AND x <> 0) / 64.0 AS new_zeros, sum(z) AS total, sum(x) AS own FROM trial GROUP BY ALL),
good AS (SELECT vec_id, t, alignment, correlation, new_zeros, total FROM aligned JOIN high USING (vec_id, t) JOIN zeros USING (vec_id, t)
  WHERE alignment >= {style.LEAST_ALIGNMENT} AND correlation >= {style.LEAST_CORRELATION} AND new_zeros <= {style.MOST_NEW_ZEROS} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY t DESC) = 1)
SELECT o.vec_id, coalesce(t, 0.0) AS step, round(coalesce(alignment, 1.0), 6) + 0.0 AS alignment, round(coalesce(correlation, 1.0), 6) + 0.0 AS correlation, coalesce(new_zeros, 0.0) AS new_zeros, round(coalesce(total, own), 6) + 0.0 AS total
FROM (SELECT vec_id, own FROM zeros WHERE t = 1) o LEFT JOIN good ON good.vec_id = o.vec_id""",
)
def _style_search(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates are a power of the voxels, blended with the volume turned round, the more the higher the label."""
    w = _LABEL_SHARE * F.col("label")
    candidate = F.zip_with("voxels", F.reverse("voxels"), lambda x, y: (1 - w) * F.pow(x, F.lit(0.8)) + w * y)
    made = style.search(embedding_volumes(spark, sf).withColumn("candidate", candidate), "candidate")
    total = F.aggregate("voxels", F.lit(0.0), lambda s, x: s + x).alias("total")
    return rounded(made.select(F.col("case_id").alias("vec_id"), "step", "alignment", "correlation", "new_zeros", total), "alignment", "correlation", "total")


# specifications of several versions

_MIDDLE = {k: str((low + high) / 2) for k, (low, high, _) in specs.NUMBERS.items()} | {k: str((low + high) / 2) for own in specs.STEPS.values() for k, (low, high, _) in own.items()} | {k: f"[{low}, {(low + high) / 2}, {high}]" for k, (low, high) in specs.TRIPLES.items()}


def _record(version: int) -> str:
    """A record's JSON, with places for the seed and the contrast, of a version."""
    own = _MIDDLE | {"version": str(version), "seed": "<seed>", "tentorium_on": "true", "contrast_scale": "0.<contrast>"}
    return "{" + ", ".join(f'"{k}": {own[k]}' for k in specs.keys(version)) + "}"


#: What is done to the records with these remainders of 13: a further key, one left out, a value beyond its bounds, two numbers for three, no object.
_FAULTS = {0: ('"seed"', '"sead": 1, "seed"'), 1: (f'"inferior_margin_mm": {_MIDDLE["inferior_margin_mm"]}, ', ""), 2: (f'"snr_ratio": {_MIDDLE["snr_ratio"]}', '"snr_ratio": 1.5'), 3: (f'"pose_scale_ras": {_MIDDLE["pose_scale_ras"]}', '"pose_scale_ras": [1, 1]'), 4: ("{", "[")}
_EXPECTED = " ".join(f"WHEN {v} THEN [{', '.join(repr(k) for k in specs.keys(v))}]" for v in range(2, 8))
_ALL_BOUNDS = ", ".join(f"('{k}', {low}, {high})" for k, (low, high, *_) in [*specs.NUMBERS.items(), *[(k, b) for own in specs.STEPS.values() for k, b in own.items()]])


@query(
    "migrated_specifications",
    f"""WITH base AS (
  SELECT c_custkey, c_custkey % 13 AS fault, replace(replace(CASE c_custkey % 7 {" ".join(f"WHEN {v - 2} THEN '{_record(v)}'" for v in range(2, 8))} ELSE replace('{_record(7)}', '"version": 7', '"version": 8') END,
    '<seed>', c_custkey::VARCHAR), '<contrast>', (10 + c_custkey % 90)::VARCHAR) AS plain FROM customer),
texts AS (SELECT c_custkey, CASE fault {" ".join(f"WHEN {n} THEN replace(plain, '{a}', '{b}')" for n, (a, b) in _FAULTS.items())} ELSE plain END AS spec FROM base),
parsed AS (SELECT c_custkey, CASE WHEN json_valid(spec) THEN spec::JSON END AS j FROM texts),
keyed AS (SELECT *, (j->>'version')::INTEGER AS source_version, json_keys(j) AS own, CASE (j->>'version')::INTEGER {_EXPECTED} END AS expected FROM parsed),
bounds AS (SELECT c_custkey, min(k) AS bad FROM keyed, (VALUES {_ALL_BOUNDS}) t(k, low, high) WHERE (j->>k)::DOUBLE NOT BETWEEN low AND high GROUP BY c_custkey),
judged AS (
  SELECT keyed.*, CASE WHEN j IS NULL THEN 'not an object' WHEN expected IS NULL THEN 'unsupported version'
    WHEN len(list_filter(own, lambda k: NOT list_contains(expected, k))) > 0 THEN 'unknown keys: ' || array_to_string(list_sort(list_filter(own, lambda k: NOT list_contains(expected, k))), ',')
    WHEN len(list_filter(expected, lambda k: NOT list_contains(own, k))) > 0 THEN 'missing keys: ' || array_to_string(list_sort(list_filter(expected, lambda k: NOT list_contains(own, k))), ',')
    WHEN source_version = 5 THEN 'version 5 can''t be replayed' WHEN bad IS NOT NULL THEN bad || ' is out of bounds' WHEN json_array_length(j->'pose_scale_ras') <> 3 THEN 'pose_scale_ras isn''t three numbers' END AS error
  FROM keyed LEFT JOIN bounds USING (c_custkey))
SELECT c_custkey, source_version, error, CASE WHEN error IS NULL THEN 7 END AS version, CASE WHEN error IS NULL THEN (j->>'seed')::BIGINT END AS seed, CASE WHEN error IS NULL THEN (j->>'contrast_scale')::DOUBLE END AS contrast_scale,
  CASE WHEN error IS NULL THEN coalesce((j->>'render_boundary_correlation_mm')::DOUBLE, 24.0) END AS correlation_mm, CASE WHEN error IS NULL THEN coalesce((j->>'acquisition_guard_dilation_mm')::DOUBLE, 0.0) END AS dilation_mm,
  CASE WHEN error IS NULL THEN (j->'pose_shift_mm_ras'->>2)::DOUBLE END AS shift_mm
FROM judged""",
)
def _migrated(spark: SparkSession, sf: str) -> DataFrame:
    """Records of all versions, and one that isn't known yet, made from the customers' keys, five kinds of fault among them."""
    key = F.col("c_custkey")
    text = F.lit(_record(7).replace('"version": 7', '"version": 8'))
    for v in range(7, 1, -1):
        text = F.when(key % 7 == v - 2, F.lit(_record(v))).otherwise(text)
    text = F.replace(F.replace(text, F.lit("<seed>"), key.cast("string")), F.lit("<contrast>"), (10 + key % 90).cast("string"))
    rows = spread(table(spark, sf, "customer").select("c_custkey")).select("c_custkey", text.alias("spec"))
    text = F.col("spec")
    for n, (a, b) in _FAULTS.items():
        text = F.when(key % 13 == n, F.replace("spec", F.lit(a), F.lit(b))).otherwise(text)
    made = specs.migrated(rows.withColumn("spec", text))
    named = {"version": "version", "seed": "seed", "contrast_scale": "contrast_scale", "correlation_mm": "render_boundary_correlation_mm", "dilation_mm": "acquisition_guard_dilation_mm"}
    return made.select("c_custkey", "source_version", "error", *[F.col(f"fields.{c}").alias(k) for k, c in named.items()], F.get("fields.pose_shift_mm_ras", 2).alias("shift_mm"))
