"""DuckDB counterparts of volume operators: keyed draws as they are, and filters as the matrices that they are on four voxels."""

from __future__ import annotations

import math

from .queries import _CL, _NORMAL, _VOX, SEED, _at, _normal, _u, _volume_sql, volume_query

Q = "'{}'".format


def _d(name: str, *parts) -> str:
    """A keyed draw; parts in brackets are SQL, others names or numbers."""
    return _u(Q(SEED), "vec_id", Q(name), *[p if str(p).startswith("(") else Q(p) for p in parts])


# operators whose draws SQL can make

_RE = "random_erasing"


def _far(n: int, axis: int) -> str:
    u = _d(_RE, "c", n, axis)
    return f"CASE WHEN {_d(_RE, 'side', n, axis)} < 0.5 THEN 0.25 * {u} ELSE 0.75 + 0.25 * {u} END * 3"


_LOBES = ", ".join([f"{_far(n, k)} AS c{n}{k}" for n in range(2) for k in range(3)] + [f"(0.12 + 0.13 * {_d(_RE, 's', n)}) * 4.0 AS s{n}" for n in range(2)])
_FADE = " * ".join(f"(1.0 - 0.5 * {present} * exp(-((a-c{n}0)*(a-c{n}0)+(b-c{n}1)*(b-c{n}1)+(c-c{n}2)*(c-c{n}2)) / (2.0 * s{n} * s{n})))" for n, present in ((0, "1.0"), (1, "two")))
volume_query(
    _RE, 0.5,
    _volume_sql(_CL.format(f"x * ({_FADE}) + 0.15 * 0.5 * spread * (1.0 - ({_FADE})) * {_normal(_RE, 'n')}"), f"SELECT vec_id, list_aggregate(v, 'stddev_pop') AS spread, CASE WHEN {_d(_RE, 'two')} < 0.5 THEN 1.0 ELSE 0.0 END AS two, {_LOBES} FROM vol"),
)
_ENDS = "c < coalesce(min(CASE WHEN x > 0.05 THEN c END) OVER (PARTITION BY vec_id, a, b), 4) OR c > coalesce(max(CASE WHEN x > 0.05 THEN c END) OVER (PARTITION BY vec_id, a, b), -1)"
for _name, _own in (("noise_straight", ""), ("noise_random", f" * {_d('noise_random', 'voxel', '(a * 4 + b)', '(c)')}")):
    volume_query(_name, 0.5, _volume_sql(f"CASE WHEN {_ENDS} THEN 0.5 * (0.05 + 0.15 * {_d(_name, 'bound', '(a * 4 + b)')}){_own} ELSE x END"))
_SB = "signal_drop_band"
_TWO = _d(_SB, "two")
_BANDS = ", ".join(f"(0.03 + 0.27 * {_d(_SB, 'width', n)}) * 2.0 AS w{n}, 0.5 * (0.4 + 0.6 * {_d(_SB, 'depth', n)}) * {'1.0' if n == 0 else f'CASE WHEN {_TWO} < 0.4 THEN 1.0 ELSE 0.0 END'} AS d{n}, {_d(_SB, 'centre', n)} * 3 AS c{n}" for n in range(2))
volume_query(_SB, 0.5, _volume_sql("x * greatest(" + " * ".join(f"(1.0 - d{n} * exp(-((a - c{n}) * (a - c{n})) / (2.0 * w{n} * w{n})))" for n in range(2)) + ", 0.15)", f"SELECT vec_id, {_BANDS} FROM vol"))
volume_query("mp2rage_background", 0.5, _volume_sql(f"CASE WHEN NOT m AND x < least THEN {_d('mp2rage_background', 'n', '(idx)')} ELSE x END", "SELECT vec_id, 0.1 * coalesce(quantile_cont(x, 0.99) FILTER (WHERE x > 0), 0.0) AS least FROM vox GROUP BY vec_id"))
volume_query("defacing", 0.5, _volume_sql("CASE WHEN b + tilt * (c - 1.5) < edge + 0.05 THEN 0.0 ELSE x END", f"SELECT vox.vec_id, coalesce(min(b) FILTER (WHERE m), 0) AS edge, any_value(-0.2 + 0.4 * {_d('defacing', 'tilt')}) AS tilt FROM vox GROUP BY vox.vec_id"))


def _waves(name: str, n: int) -> None:
    turn = lambda w: " + ".join(f"{2 * math.pi!r} * f{w}{k} * {p} / 4" for k, p in enumerate("abc"))
    f = ", ".join(f"floor((0.1 + 0.4 * {_d(name, 'f', w, k)}) * 4) * CASE WHEN {_d(name, 'sign', w, k)} < 0.5 THEN -1 ELSE 1 END AS f{w}{k}" for w in range(n) for k in range(3))
    phases = ", ".join(f"{2 * math.pi!r} * {_d(name, 'phase', w)} AS p{w}" for w in range(n))
    volume_query(name, 0.5, _volume_sql("x + " + " + ".join(f"2.0 * size * cos({turn(w)} + p{w})" for w in range(n)), f"SELECT vec_id, 0.275 * abs(list_sum(v)) / 64 AS size, {f}, {phases} FROM vol"))


_waves("spike", 1)
_waves("herringbone", 4)
_ZL = ", ".join(f"floor((0.5 + 0.35 * ({_d('zipper', 'a', n)} + {_d('zipper', 'b', n)} - 1.0)) * 4) AS z{n}, floor({_d('zipper', 'w', n)} * 3) + 1 AS w{n}" for n in range(2))
volume_query(
    "zipper", 0.5,
    _volume_sql(f"CASE WHEN {' OR '.join(f'(a >= z{n} AND a < z{n} + w{n})' for n in range(2))} THEN {_CL.format('x + CASE WHEN b % 2 = 0 THEN 1.0 ELSE -1.0 END * 0.6 * ref')} ELSE x END", f"SELECT vec_id, ref, {_ZL} FROM (SELECT vec_id, coalesce(quantile_cont(x, 0.5) FILTER (WHERE m), quantile_cont(x, 0.85) FILTER (WHERE x > 0), 0.0) AS ref FROM vox GROUP BY vec_id)"),
)
volume_query(
    "motion_pulsation", 0.5,
    f"""WITH {_VOX}, sx AS (SELECT vec_id, count(*) FILTER (WHERE m) AS n, quantile_cont(x, 0.8) FILTER (WHERE m) AS bar FROM vox GROUP BY vec_id),
    src AS (SELECT vec_id, (a + 1) % 4 AS a, b, c, x AS y, m AS my FROM vox)
    SELECT vec_id, idx::INTEGER AS idx, round({_CL.format('CASE WHEN n >= 8 AND my AND y >= bar THEN x + 0.4 * y ELSE x END')}, 6) + 0.0 AS value FROM vox JOIN src USING (vec_id, a, b, c) JOIN sx USING (vec_id)""",
    offsets=(1,), alphas=(0.4,), bright_pct=80.0, least=8,
)


# filters: on an axis of four voxels each is a matrix, made here from its taps by plain loops

Matrix = list[list[float]]


def _mirror(at: int, n: int = 4) -> int:
    at %= 2 * n
    return at if at < n else 2 * n - 1 - at


def _filter(taps: list[float]) -> Matrix:
    out, r = [[0.0] * 4 for _ in range(4)], len(taps) // 2
    for to in range(4):
        for k, t in enumerate(taps):
            out[to][_mirror(to + k - r)] += t
    return out


def _gauss(sigma: float) -> Matrix:
    r = int(4 * sigma + 0.5)
    taps = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return _filter([t / sum(taps) for t in taps])


def _sql(m: Matrix) -> str:
    return "[" + ", ".join("[" + ", ".join(map(repr, row)) + "]" for row in m) + "]"


def _axis0(m: Matrix) -> str:
    return " + ".join(f"[{', '.join(repr(m[to][of]) for to in range(4))}][a + 1] * {_at(a=str(of))}" for of in range(4))


def _three(m: Matrix, n: Matrix, o: Matrix) -> str:
    """The sum over the pairs p, q of voxels that filters all three axes."""
    return f"sum(q.x * {_sql(m)}[p.a + 1][q.a + 1] * {_sql(n)}[p.b + 1][q.b + 1] * {_sql(o)}[p.c + 1][q.c + 1])"


# Thick slices at ratio 2: a Gaussian of 0.5, the first and last of the four, and lines between them.
_G = _gauss(0.5)
volume_query("anisotropy", 0.5, _volume_sql(_axis0([[(1 - t) * _G[0][k] + t * _G[3][k] for k in range(4)] for t in (0, 1 / 3, 2 / 3, 1)])), axis=0, ratio=2.0)


def _line_blur(length: float, theta: float) -> list[Matrix]:
    """Weights [to][from] over the 16 places of a slice, from the line's taps."""
    r = max(1, math.ceil(length / 2))
    taps = {}
    for u in range(-r, r + 1):
        for w in range(-r, r + 1):
            along, across = u * math.cos(theta) + w * math.sin(theta), -u * math.sin(theta) + w * math.cos(theta)
            taps[u, w] = min(1.0, max(0.0, length / 2 + 0.5 - abs(along))) * min(1.0, max(0.0, 1 - abs(across)))
    total, out = sum(taps.values()), [[0.0] * 16 for _ in range(16)]
    for to in range(16):
        for (u, w), t in taps.items():
            out[to][4 * _mirror(to // 4 + u) + _mirror(to % 4 + w)] += t / total
    return out


_LB = _line_blur(2.0, 0.5)
volume_query("motion_blur", 0.5, _volume_sql(" + ".join(f"[{', '.join(repr(_LB[to][of]) for to in range(16))}][4 * a + b + 1] * {_at(str(of // 4), str(of % 4))}" for of in range(16))), length=2.0, theta=0.5)

# An echo train of 8 with a decay of 0.1: the envelope over the four lines, and the circulant kernel of its real part.
_ENVELOPE = [1.0 if k == 0 else math.exp(-0.1 * math.floor(min(k, 4 - k) / 0.25)) for k in range(4)]
_KERNEL = [sum(e * math.cos(2 * math.pi * k * d / 4) for k, e in enumerate(_ENVELOPE)) / 4 for d in range(4)]
_BLURRED = " + ".join(f"{h!r} * {_at(b=f'(b - {d} + 4) % 4')}" for d, h in enumerate(_KERNEL))
volume_query("fse_echo_train", 0.5, _volume_sql(_CL.format(f"x + {_CL.format('x / greatest(top, 1e-9)')} * (({_BLURRED}) - x)"), "SELECT vec_id, coalesce(quantile_cont(x, 0.99) FILTER (WHERE x > 0), 0.0) AS top FROM vox GROUP BY vec_id"), etl=8, decay=0.1)

_G1 = _gauss(1.0)
volume_query(
    "mp2rage_grain", 0.5,
    f"""WITH {_VOX}, sx AS (SELECT vec_id, avg(x) AS mu, stddev_pop(x) AS sd FROM vox GROUP BY vec_id),
    g AS (SELECT p.vec_id, p.idx, {_three(_G1, _G1, _G1)} AS y FROM vox p JOIN vox q USING (vec_id) GROUP BY p.vec_id, p.idx, p.a, p.b, p.c),
    n AS (SELECT vec_id, avg(y) AS my, stddev_pop(y) AS sy FROM g GROUP BY vec_id)
    SELECT vec_id, idx::INTEGER AS idx, round(mu + (y - my) * CASE WHEN sy > 0 THEN sd / sy ELSE 1.0 END, 6) + 0.0 AS value FROM g JOIN n USING (vec_id) JOIN sx USING (vec_id)""",
    grain_sg=1.0,
)

_EDGE, _SMOOTH = _filter([-1.0, 0.0, 1.0]), _filter([1.0, 2.0, 1.0])


def _t2(low: str, high: str, targets: tuple[float, float, float], width: str, after: str) -> str:
    """The soft remap of tissue contrast; `after` is the value from x, out (before clipping) and the mask's mean."""
    gradients = ", ".join(f"{_three(*[_EDGE if k == axis else _SMOOTH for k in range(3)])} AS g{axis}" for axis in range(3))
    step = lambda t: f"(1 / (1 + exp(-least(greatest((blur - {t}) / greatest({width}, 1e-6), -30), 30))))"
    dark, middle, bright = targets
    flat = f"({dark} * (1 - lo) + {middle} * lo * (1 - hi) + {bright} * lo * hi)"
    return f"""WITH {_VOX}, sx AS (SELECT vec_id, count(*) FILTER (m) AS n, avg(x) FILTER (m) AS mu, quantile_cont(x, 0.20) FILTER (m) AS p20, quantile_cont(x, 0.67) FILTER (m) AS p67, max(x) FILTER (m) - min(x) FILTER (m) AS spread FROM vox GROUP BY vec_id),
    f AS (SELECT p.vec_id, p.idx, p.x, p.m, {_three(*[_gauss(0.6)] * 3)} AS blur, {_three(*[_gauss(2.0)] * 3)} AS wide, {gradients} FROM vox p JOIN vox q USING (vec_id) GROUP BY p.vec_id, p.idx, p.x, p.m, p.a, p.b, p.c),
    s AS (SELECT f.*, sx.* EXCLUDE (vec_id), {step(low)} AS lo, {step(high)} AS hi, 0.7 * (x - wide) / (1 + (g0 * g0 + g1 * g1 + g2 * g2) / 0.0064) AS kept FROM f JOIN sx USING (vec_id)),
    o AS (SELECT *, CASE WHEN m THEN {flat} + kept ELSE x * 0.7 END AS y FROM s)
    SELECT vec_id, idx::INTEGER AS idx, round(CASE WHEN n = 0 THEN x ELSE {after} END, 6) + 0.0 AS value FROM o"""


volume_query("t2_remap", 0.5, _t2("0.2", "0.6", (0.9, 0.55, 0.4), "0.09", _CL.format(f"CASE WHEN m THEN {_CL.format('y')} + 0.12 * (x - mu) ELSE {_CL.format('y')} END")))
volume_query("t2_3d", 0.5, _t2("p20", "p67", (0.95, 0.5, 0.24), "0.09 * greatest(spread, 1e-6)", _CL.format("x + 0.5 * (y - x)")))

# The outer shell moves by one voxel along the first axis.
volume_query(
    "chemical_shift", 0.5,
    f"""WITH {_VOX}, sx AS (SELECT vec_id, 0.25 * median(x) FILTER (x > 0) AS bar, coalesce(quantile_cont(x, 0.6) FILTER (x > 0), 0.0) AS top FROM vox GROUP BY vec_id),
    h AS (SELECT vox.*, top, coalesce(x > bar, false) AS head FROM vox JOIN sx USING (vec_id)),
    e AS (SELECT p.vec_id, p.a, p.b, p.c, bool_or(NOT q.head) AS open FROM h p JOIN h q ON p.vec_id = q.vec_id AND abs(p.a - q.a) + abs(p.b - q.b) + abs(p.c - q.c) = 1 GROUP BY ALL),
    f AS (SELECT h.vec_id, a, b, c, idx, x, CASE WHEN head AND open AND x > top THEN x ELSE 0.0 END AS fat FROM h JOIN e USING (vec_id, a, b, c))
    SELECT f.vec_id, f.idx::INTEGER AS idx, round({_CL.format('f.x + 0.5 * (coalesce(g.fat, 0.0) - 0.8 * f.fat)')}, 6) + 0.0 AS value FROM f LEFT JOIN f g ON g.vec_id = f.vec_id AND g.a = f.a - 1 AND g.b = f.b AND g.c = f.c""",
    axis=0, shift=1,
)


# motion: the transform over four places an axis, written out as sums of cosines

_DEGREE = math.pi / 180


def _motion_sql() -> str:
    """Poses, posed images, and the real part of the inverse of the composed spectrum; y runs along the phase axis."""
    pose = ", ".join(f"calm * {most} * (2 * {_d('motion', name, '(p)')} - 1) AS {name}" for name, most in (("dy", "0.2"), ("dx", "0.2"), ("turn", "3.0")))
    y, x = "least(greatest(cos(turn * {0}) * (y - 1.5) + sin(turn * {0}) * (x - 1.5) + 1.5, 0.0), 3.0)", "least(greatest(-sin(turn * {0}) * (y - 1.5) + cos(turn * {0}) * (x - 1.5) + 1.5, 0.0), 3.0)"
    spot = lambda i, j: f"CASE WHEN axis = 0 THEN {_at(i, j)} ELSE {_at(j, i)} END"
    near = [[spot(i, j) for j in ("j", "least(j + 1, 3)")] for i in ("i", "least(i + 1, 3)")]
    return f"""WITH {_NORMAL},
    drawn AS (SELECT vec_id, v, CASE WHEN {_d('motion', 'axis')} < 0.5 THEN 0 ELSE 1 END AS axis, {_d('motion', 'centric')} < 0.4 AS centric FROM vol),
    pose AS (SELECT vec_id, p, {pose} FROM drawn, (SELECT p, CASE WHEN p = 8 THEN 0.25 ELSE 1.0 END AS calm FROM (VALUES (0), (1), (2), (3), (8)) t(p))),
    spots AS (SELECT vec_id, p, y, x, {y.format(_DEGREE)} AS py, {x.format(_DEGREE)} AS px FROM pose, range(4) r(y), range(4) s(x)),
    cells AS (SELECT *, floor(py)::INTEGER AS i, floor(px)::INTEGER AS j FROM spots),
    posed AS (
      SELECT vec_id, p, y, x, c, (1 - (py - i)) * ((1 - (px - j)) * {near[0][0]} + (px - j) * {near[0][1]}) + (py - i) * ((1 - (px - j)) * {near[1][0]} + (px - j) * {near[1][1]}) AS g
      FROM cells JOIN drawn USING (vec_id), range(4) r(c)),
    lines AS (SELECT vec_id, axis, fy - 2 AS fy, CASE WHEN centric AND fy >= 1 THEN 8 ELSE fy END AS p FROM drawn, range(4) r(fy)),
    waves AS (SELECT vec_id, axis, p, fy, fx - 2 AS fx, dy, dx FROM lines JOIN pose USING (vec_id, p), range(4) r(fx)),
    spectrum AS (
      SELECT w.vec_id, axis, c, fy, fx, sum(g * cos({2 * math.pi!r} * (fy * (y + dy) + fx * (x + dx)) / 4)) AS re, -sum(g * sin({2 * math.pi!r} * (fy * (y + dy) + fx * (x + dx)) / 4)) AS im
      FROM waves w JOIN posed q ON q.vec_id = w.vec_id AND q.p = w.p GROUP BY ALL),
    back AS (
      SELECT vec_id, axis, c, y, x, sum(re * cos({2 * math.pi!r} * (fy * y + fx * x) / 4) - im * sin({2 * math.pi!r} * (fy * y + fx * x) / 4)) / 16 AS value
      FROM spectrum, range(4) r(y), range(4) s(x) GROUP BY ALL)
    SELECT vec_id, (CASE WHEN axis = 0 THEN 16 * y + 4 * x ELSE 16 * x + 4 * y END + c)::INTEGER AS idx, round({_CL.format('value')}, 6) + 0.0 AS value FROM back"""


volume_query("motion", 0.5, _motion_sql())


def _walk_sql(name: str) -> str:
    """The centred and smoothed walk over four lines, scaled to its reach."""
    normal = lambda r: f"(sqrt(-2 * ln(greatest({_d('motion_continuous', name, f'({r})', 'a')}, {2.0**-33!r}))) * cos({2 * math.pi!r} * {_d('motion_continuous', name, f'({r})', 'b')}))"
    g = _gauss(0.5)
    steps = ", ".join(f"{normal(r)} AS s{r}" for r in range(4))
    so_far = ", ".join(" + ".join(f"s{q}" for q in range(r + 1)) + f" AS t{r}" for r in range(4))
    smooth = ", ".join(" + ".join(f"{g[r][q]!r} * t{q}" for q in range(4)) + f" AS w{r}" for r in range(4))
    mean = "(w0 + w1 + w2 + w3) / 4"
    scaled = ", ".join(f"(w{r} - {mean}) / (greatest({', '.join(f'abs(w{q} - {mean})' for q in range(4))}) + 1e-9) * 0.24" for r in range(4))
    return f"{name} AS (SELECT vec_id, [{scaled}] AS s{name} FROM (SELECT vec_id, {smooth} FROM (SELECT vec_id, {so_far} FROM (SELECT vec_id, {steps} FROM vol))))"


volume_query(
    "motion_continuous", 0.5,
    f"""WITH {_VOX}, {_walk_sql('y')}, {_walk_sql('x')},
    spectrum AS (
      SELECT vec_id, c, fy - 2 AS fy, fx - 2 AS fx, sum(vox.x * cos({2 * math.pi!r} * ((fy - 2) * (a + sy[fy + 1]) + (fx - 2) * (b + sx[fy + 1])) / 4)) AS re,
        -sum(vox.x * sin({2 * math.pi!r} * ((fy - 2) * (a + sy[fy + 1]) + (fx - 2) * (b + sx[fy + 1])) / 4)) AS im
      FROM vox JOIN y USING (vec_id) JOIN x USING (vec_id), range(4) r(fy), range(4) s(fx) GROUP BY ALL),
    back AS (
      SELECT vec_id, a, b, c, sum(re * cos({2 * math.pi!r} * (fy * a + fx * b) / 4) - im * sin({2 * math.pi!r} * (fy * a + fx * b) / 4)) / 16 AS value
      FROM spectrum, range(4) r(a), range(4) s(b) GROUP BY ALL)
    SELECT vec_id, (16 * a + 4 * b + c)::INTEGER AS idx, round({_CL.format('value')}, 6) + 0.0 AS value FROM back""",
)
