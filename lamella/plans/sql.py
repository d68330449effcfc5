"""SQL that states each operator anew, for a second engine to check the queries against. Nothing here is read by the engine."""

from __future__ import annotations

import numpy as np

from ..functions.kernels import depth_weights, plane_kernel
from ..functions.linear import YIQ
from ..sources.tables import deep_sql, mask_sql

RGB = ("red", "green", "blue")
RGBA = (*RGB, "alpha")
ALL = ("alpha", *RGB, "id", "pos_x", "pos_y", "pos_z")
CORE = ("alpha", *RGB)


def num(v: float) -> str:
    return f"({float(v)!r}e0)" if "e" not in repr(float(v)) else f"({float(v)!r})"


def q(expression: str, name: str) -> str:
    return f"CAST(floor(({expression}) * 1e6 + 5e-1) AS BIGINT) AS {name}"


def out(source: str, plain: str, *channels: str) -> str:
    return f"SELECT {plain}, {', '.join(q(c, c) for c in channels)} FROM {source}"


def deep(where: str = "1 = 1", ordered: bool = False, name: str = "deep") -> str:
    return f"{name} AS ({deep_sql(where, ordered)})"


UNPREMULT = "u AS (SELECT *, " + ", ".join(f"CASE WHEN alpha <> 0 THEN {c} / alpha ELSE 0e0 END AS v_{c}" for c in RGB) + " FROM deep)"


def colour(red: str, green: str | None = None, blue: str | None = None, weight: str = "", source: str = "u", more: str = "") -> str:
    """Expressions over ``v`` for each channel; one for all if only one is given."""
    made = []
    for c, f in zip(RGB, (red, green or red, blue or red), strict=True):
        v = f"v_{c}"
        f = f.replace("{v}", v)
        value = f"(({f}) * ({weight}) + {v} * (1e0 - ({weight}))) * alpha" if weight else f"({f}) * alpha"
        if weight:
            value = f"CASE WHEN ({weight}) = 0 THEN {c} ELSE {value} END"
        made.append(q(value, c))
    return f"WITH {deep()}, {UNPREMULT}{more} SELECT x, y, {q('front', 'front')}, {q('alpha', 'alpha')}, {', '.join(made)} FROM {source}"


def lum(mode: str) -> str:
    r, g, b = (f"v_{c}" for c in RGB)
    if mode == "maximum":
        return f"greatest({r}, {g}, {b})"
    w = {"rec709": (0.2126, 0.7152, 0.0722), "ccir601": (0.299, 0.587, 0.114), "average": (1 / 3,) * 3}[mode]
    return f"({r} * {num(w[0])} + {g} * {num(w[1])} + {b} * {num(w[2])})"


def linear(m) -> list[str]:
    return [" + ".join(f"v_{c} * {num(x)}" for c, x in zip(RGB, row, strict=True)) for row in m]


def hue(degrees: float, saturation: float, value: float) -> str:
    u, w = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    yiq = linear(YIQ)
    turned = f"""t AS (SELECT *, yy * {num(value)} AS y2, {num(value * saturation)} * ({num(u)} * ii - {num(w)} * qq) AS i2, {num(value * saturation)} * ({num(w)} * ii + {num(u)} * qq) AS q2
      FROM (SELECT *, {yiq[0]} AS yy, {yiq[1]} AS ii, {yiq[2]} AS qq FROM u))"""
    back = [" + ".join(f"{n} * {num(x)}" for n, x in zip(("y2", "i2", "q2"), row, strict=True)) for row in np.linalg.inv(YIQ)]
    return colour(*back, source="t", more=f", {turned}")


GRADE_SQL = "pow(1.125e0 * {v} + 1e-1, 5e-1)"
MASKED = f", m AS ({mask_sql()}), j AS (SELECT u.*, greatest(least(coalesce(m.value, 0e0), 1e0), 0e0) AS sm FROM u LEFT JOIN m ON u.x = m.x AND u.y = m.y)"

ORDER = "ORDER BY front, back, s"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def let_through(source: str, keys: str = "x, y", name: str = "t") -> str:
    return f"{name} AS (SELECT *, coalesce(product(1e0 - alpha) OVER (PARTITION BY {keys} {ORDER} {BEFORE}), 1e0) AS t FROM {source})"


def composite(source: str, keys: str, channels=CORE, name: str = "c", depth: bool = True, t: str = "t") -> str:
    """CTEs ``t`` and ``name``: the groups of ``keys`` composited."""
    ends = "min(front) FILTER (t > 0) AS front, max(back) FILTER (t > 0) AS back, " if depth else ""
    made = ", ".join(f"sum({c} * t) AS {c}" for c in channels)
    return f"{let_through(source, keys, t)}, {name} AS (SELECT {keys}, {ends}min(s) AS s, {made} FROM {t} GROUP BY {keys})"


def grouped(source: str, tolerance: float, differs: str, channels=CORE, name: str = "g") -> str:
    """CTEs that number the samples and carry the start of each group from row to row; differs: over a.c (start) and v.c."""
    carried = ("front", *channels)
    fits = f"v.front - r.a_front <= {num(tolerance)} AND NOT ({differs})"
    kept = ", ".join(f"CASE WHEN {fits} THEN r.a_{c} ELSE v.{c} END AS a_{c}" for c in carried)
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY x, y {ORDER}) AS n FROM {source}),
{name}_r AS (SELECT x, y, n, 0 AS g, {", ".join(f"{c} AS a_{c}" for c in carried)} FROM {name}_n WHERE n = 1
  UNION ALL SELECT v.x, v.y, v.n, CASE WHEN {fits} THEN r.g ELSE r.g + 1 END, {kept} FROM {name}_r r JOIN {name}_n v ON v.x = r.x AND v.y = r.y AND v.n = r.n + 1),
{name} AS (SELECT v.*, r.g FROM {name}_n v JOIN {name}_r r ON v.x = r.x AND v.y = r.y AND v.n = r.n)"""


def unpremult_differs(channels) -> str:
    """Unpremultiplied colours of the group's start and the sample, as far apart as ..."""
    apart = ", ".join(f"abs(CASE WHEN r.a_alpha <> 0 THEN r.a_{c} / r.a_alpha ELSE 0e0 END - CASE WHEN v.alpha <> 0 THEN v.{c} / v.alpha ELSE 0e0 END)" for c in channels)
    return f"r.a_alpha >= 1e-6 AND v.alpha >= 1e-6 AND greatest({apart}) > "


PREMULT_DIFFERS = "greatest(abs(r.a_red - v.red), abs(r.a_green - v.green), abs(r.a_blue - v.blue)) > "


def alive(source: str, occlusion: float | None, contribution: float | None, alpha: float | None, clip: tuple[float, float] | None, name: str = "alive") -> str:
    """CTEs that walk each pixel's samples and mark those that passes 1 to 4 leave."""
    one = "TRUE"
    if clip:
        one += f" AND v.front >= {num(clip[0])} AND v.front <= {num(clip[1])}"
    if alpha is not None:
        one += f" AND v.alpha > {num(alpha)}"

    def step(o: str, c: str) -> tuple[str, str, str]:
        seen = f"({one}) AND ({o} < {num(occlusion)})" if occlusion is not None else f"({one})"
        o2 = f"CASE WHEN {seen} THEN {o} + v.alpha * (1e0 - {o}) ELSE {o} END" if occlusion is not None else o
        live = f"({seen}) AND v.alpha * (1e0 - {c}) >= {num(contribution)}" if contribution is not None else seen
        return o2, f"CASE WHEN {live} THEN {c} + v.alpha * (1e0 - {c}) ELSE {c} END", live

    first, later = step("0e0", "0e0"), step("r.o", "r.c")
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY x, y {ORDER}) AS n FROM {source}),
{name}_r AS (SELECT v.x, v.y, v.n, {first[0]} AS o, {first[1]} AS c, {first[2]} AS live FROM {name}_n v WHERE v.n = 1
  UNION ALL SELECT v.x, v.y, v.n, {later[0]}, {later[1]}, {later[2]} FROM {name}_r r JOIN {name}_n v ON v.x = r.x AND v.y = r.y AND v.n = r.n + 1),
{name} AS (SELECT v.*, r.live FROM {name}_n v JOIN {name}_r r ON v.x = r.x AND v.y = r.y AND v.n = r.n)"""


def collapsed(source: str, alpha_max: float, size: int, live: str = "TRUE", name: str = "kept") -> str:
    return f"""{name}_a AS (SELECT *, ({live}) AND alpha < {num(alpha_max)} AS thin, row_number() OVER (PARTITION BY x, y {ORDER}) AS rn FROM {source}),
{name}_b AS (SELECT *, rn - row_number() OVER (PARTITION BY x, y, thin {ORDER}) AS island FROM {name}_a),
{name}_c AS (SELECT *, row_number() OVER (PARTITION BY x, y, thin, island {ORDER}) - 1 AS p, count(*) OVER (PARTITION BY x, y, thin, island) AS l FROM {name}_b),
{name} AS (SELECT * FROM {name}_c WHERE NOT (thin AND (floor(p / {size}.0) + 1) * {size} <= l AND p % {size} <> 0))"""


def tidied(source: str, channels=CORE, name: str = "tidy") -> str:
    colours = [c for c in channels if c != "alpha"]
    alpha = "CASE WHEN a = f0 AND b = b0 THEN a0 ELSE 1e0 - pow(1e0 - a0, (b - a) / (b0 - f0)) END"
    share = "CASE WHEN a = f0 AND b = b0 THEN 1e0 WHEN a0 > 1e-6 THEN alpha / a0 ELSE 0e0 END"
    return f"""{name}_p AS (SELECT x, y, front AS p FROM {source} UNION SELECT x, y, back FROM {source}),
{name}_e AS (SELECT d.x, d.y, d.s, d.front AS f0, d.back AS b0, d.alpha AS a0, {", ".join(f"d.{c} AS c_{c}" for c in colours)}, p.p AS a, lead(p.p) OVER (PARTITION BY d.x, d.y, d.s ORDER BY p.p) AS b
  FROM {source} d JOIN {name}_p p ON d.x = p.x AND d.y = p.y AND p.p >= d.front AND p.p <= d.back),
{name}_f AS (SELECT * REPLACE (CASE WHEN f0 = b0 THEN a ELSE b END AS b) FROM {name}_e WHERE b IS NOT NULL OR f0 = b0),
{name}_g AS (SELECT x, y, s, a AS front, b AS back, {", ".join(f"c_{c} * ({share}) AS {c}" for c in colours)}, alpha FROM (SELECT *, {alpha} AS alpha FROM {name}_f)),
{composite(f"{name}_g", "x, y, front, back", channels, name, False, f"{name}_t")}"""


def optimised(source: str, merge: float, colour_tolerance: float, cap: int, channels=CORE, name: str = "o") -> str:
    """CTEs up to ``name``; WITH must be RECURSIVE."""
    return f"""{tidied(source, channels, f"{name}_tidy")}, {grouped(f"{name}_tidy", merge, unpremult_differs([c for c in channels if c != "alpha"][:3]) + num(colour_tolerance), channels, f"{name}_g")},
{name}_k AS (SELECT * EXCLUDE (n) FROM {name}_g {f"WHERE g < {cap}" if cap else ""}), {composite(f"{name}_k", "x, y, g", channels, name, True, f"{name}_t")}"""


def scattered(source: str, width: float, height: float, quality: str, channels=CORE, name: str = "sc") -> str:
    kernel = plane_kernel(width, height, quality)
    values = ", ".join(f"({dx}, {dy}, {num(w)}, {i})" for i, (dx, dy, w) in enumerate(kernel))
    return f"{name} AS (SELECT d.x + k.dx AS x, d.y + k.dy AS y, d.s * {len(kernel)} + k.i AS s, front, back, {', '.join(f'{c} * k.w AS {c}' for c in channels)} FROM {source} d CROSS JOIN (VALUES {values}) k(dx, dy, w, i))"


def depth_blurred(source: str, spread: float, n: int, falloff: str, flat: bool = False, gate: str | None = None, channels=CORE, name: str = "db") -> str:
    values = ", ".join(f"({i}, {num(w)})" for i, w in enumerate(depth_weights(n, falloff)))
    step = spread / n
    centre = f"(front - {num(spread / 2)} + {num(step / 2)} + k.i * {num(step)})"
    front, back = (centre, centre) if flat else (f"{centre} - {num(step / 2)}", f"{centre} + {num(step / 2)}")
    hit = "TRUE"
    if gate:
        hit = f"(NOT EXISTS (SELECT 1 FROM {gate} h WHERE h.x = d.x AND h.y = d.y) OR EXISTS (SELECT 1 FROM {gate} h WHERE h.x = d.x AND h.y = d.y AND d.back + {num(spread / 2)} >= h.front AND d.front - {num(spread / 2)} <= h.back))"
    rest = [c for c in channels if c != "alpha"]
    return f"""{name}_s AS (SELECT d.*, alpha >= 1e-6 AND {hit} AS spreads FROM {source} d),
{name}_u AS (SELECT x, y, s * {n} AS s, front, back, alpha, {", ".join(rest)} FROM {name}_s WHERE NOT spreads
  UNION ALL SELECT x, y, s * {n} + i, f, b, a, {", ".join(f"{c} * (a / alpha)" for c in rest)} FROM
    (SELECT d.*, k.i, {front} AS f, {back} AS b, 1e0 - pow(1e0 - alpha, k.w) AS a FROM {name}_s d CROSS JOIN (VALUES {values}) k(i, w) WHERE spreads) WHERE a >= 1e-6),
{name} AS (SELECT * REPLACE (least(back, coalesce(lead(front) OVER (PARTITION BY x, y {ORDER}), back)) AS back) FROM {name}_u)"""
