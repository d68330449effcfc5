"""Named queries of the deep-image engine over the order tables, and the SQL they are checked against.

Computed numbers are given in millionths, rounded half up, so that two engines agree whatever the last bits are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.noise import Noise
from ..operators import blur as B
from ..operators import channels as H
from ..operators import color as C
from ..operators import depth_blur as D
from ..operators import geometry as G
from ..operators import masks as K
from ..operators import matte as M
from ..operators import ordered as O
from ..operators import thin as T
from ..operators import tidy as Y
from ..sources import tables
from ..sources.constant import constant
from ..sources.image import RGB, DeepImage
from . import sql as S
from . import table_functions
from .noise_sql import noise_matte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def millionths(df: DataFrame, plain: list[str], channels: list[str]) -> DataFrame:
    return df.select(*plain, *[F.floor(F.col(c) * 1e6 + 0.5).cast("bigint").alias(c) for c in channels])


def core(image: DeepImage) -> DeepImage:
    """The image without what the query doesn't need, before samples multiply."""
    return image.with_df(image.df.select("x", "y", "s", "front", "back", "alpha", *RGB))


def register(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def _colour(name: str, fn, oracle: str) -> None:
    register(name, lambda s, d: millionths(fn(tables.deep(s, d, ordered=False)).df, ["x", "y"], ["front", "alpha", *RGB]), oracle)


# colour operators
_colour("add", lambda i: C.add(i, (0.1, 0.2, 0.3)), S.colour("{v} + 1e-1", "{v} + 2e-1", "{v} + 3e-1"))
_colour("multiply", lambda i: C.multiply(i, (0.5, 1.5, 2)), S.colour("{v} * 5e-1", "{v} * 15e-1", "{v} * 2e0"))
_colour("gain", lambda i: C.gain(i, 1.25), S.colour("{v} * 125e-2"))
_colour("gamma", lambda i: C.gamma(i, (2.2, 1, 0.45)), S.colour("pow({v}, 1e0 / 22e-1)", "{v}", "pow({v}, 1e0 / 45e-2)"))
_colour("invert", lambda i: C.invert(C.multiply(i, (2, 2, 2))), S.colour("1e0 - {v} * 2e0"))
_colour("invert_clamped", lambda i: C.invert(C.multiply(i, (2, 2, 2)), clamped=True), S.colour("least(greatest(1e0 - {v} * 2e0, 0e0), 1e0)"))
_colour("clamp", lambda i: C.clamp_channels(i, (0.2,) * 3, (0.7,) * 3), S.colour("CASE WHEN {v} > 7e-1 THEN 7e-1 WHEN {v} < 2e-1 THEN 2e-1 ELSE {v} END"))
_colour("clamp_to", lambda i: C.clamp_channels(i, (0.5,) * 3, (0.3,) * 3, min_clamp_to=(0.1,) * 3, max_clamp_to=(0.9,) * 3, min_clamp_to_enable=True, max_clamp_to_enable=True), S.colour("CASE WHEN {v} > 3e-1 THEN 9e-1 WHEN {v} < 5e-1 THEN 1e-1 ELSE {v} END"))
_colour("posterize", lambda i: C.posterize(C.add(i, (-0.5,) * 3), 10), S.colour("sign({v} - 5e-1) * floor(abs({v} - 5e-1) * 1e1) / 1e1"))
_GRADE = {"whitepoint": 0.8, "black": 0.1, "white": 1.0, "gamma": 2.0}
_colour("grade", lambda i: C.grade(i, **_GRADE), S.colour(S.GRADE_SQL))
_colour("grade_reverse", lambda i: C.grade(i, reverse=True, black_clamp=True, white_clamp=True, **_GRADE), S.colour("least(greatest(pow({v}, 2e0) * (1e0 / 1125e-3) + (-1e-1 * (1e0 / 1125e-3)), 0e0), 1e0)"))
for _mode in ("rec709", "ccir601", "average", "maximum"):
    _colour(f"saturation_{_mode}", lambda i, m=_mode: C.saturation(i, 0.5, m), S.colour("{v} * 5e-1 + " + S.lum(_mode) + " * (1e0 - 5e-1)"))
_colour("hue_shift", lambda i: C.hue_shift(i, 120, 0.8, 1.1), S.hue(120, 0.8, 1.1))
_MATRIX = [[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.05, 0.15, 0.8]]
_colour("color_matrix", lambda i: C.color_matrix(i, _MATRIX), S.colour(*S.linear(_MATRIX)))
_colour("color_matrix_inverse", lambda i: C.color_matrix(i, _MATRIX, invert=True), S.colour(*S.linear(np.linalg.inv(_MATRIX))))
_colour(
    "color_lookup",
    lambda i: C.color_lookup(i, master=((0, 0), (0.5, 0.7), (1, 1)), red=((0, 0.1), (1, 0.9))),
    S.colour(*["CASE WHEN {v} < 5e-1 THEN {v} * 14e-1 ELSE ({v} - 5e-1) * 6e-1 + 7e-1 END" if k else "CASE WHEN {v} < 5e-1 THEN {v} * 14e-1 ELSE ({v} - 5e-1) * 6e-1 + 7e-1 END * 8e-1 + 1e-1" for k in range(3)]),
)
# through (0, 0), (1/2, 71391/100000), (1, 1): slopes 142782/100000, 1 and 57218/100000 at the points; each piece by Hermite's four polynomials
_PIECE = "({y0} * (2e0 * {t} * {t} * {t} - 3e0 * {t} * {t} + 1e0) + 5e-1 * {m0} * ({t} * {t} * {t} - 2e0 * {t} * {t} + {t}) + {y1} * (3e0 * {t} * {t} - 2e0 * {t} * {t} * {t}) + 5e-1 * {m1} * ({t} * {t} * {t} - {t} * {t}))"
_colour(
    "color_lookup_smooth",
    lambda i: C.color_lookup(C.add(i, (0.2,) * 3), master=((0, 0), (0.5, 0.71391), (1, 1)), smooth=True),
    S.colour(f"CASE WHEN ({{v}} + 2e-1) > 1e0 THEN 1e0 + (({{v}} + 2e-1) - 1e0) * 57218e-5 WHEN ({{v}} + 2e-1) < 5e-1 THEN {_PIECE.format(t='(({v} + 2e-1) * 2e0)', y0='0e0', y1='71391e-5', m0='142782e-5', m1='1e0')} ELSE {_PIECE.format(t='(({v} + 2e-1) * 2e0 - 1e0)', y0='71391e-5', y1='1e0', m0='1e0', m1='57218e-5')} END"),
)
_colour("grade_mix", lambda i: C.grade(i, mix=0.25, **_GRADE), S.colour(S.GRADE_SQL, weight="25e-2"))
_colour("grade_deep_mask", lambda i: C.grade(i, deep_mask="blue", invert_deep_mask=True, **_GRADE), S.colour(S.GRADE_SQL, weight="1e0 - v_blue"))


def _grade_side(s: SparkSession, d: str) -> DataFrame:
    out = C.grade(tables.deep(s, d, ordered=False), side_mask=tables.mask(s, d), invert_mask=True, mix=0.5, **_GRADE)
    return millionths(out.df, ["x", "y"], ["front", "alpha", *RGB])


register("grade_side_mask", _grade_side, S.colour(S.GRADE_SQL, weight="5e-1 * (1e0 - sm)", source="j", more=S.MASKED))


# projections
def _projection(name: str, fn, select: str, channels: list[str]) -> None:
    register(name, lambda s, d: millionths(fn(tables.deep(s, d, ordered=False)).df, ["x", "y"], channels), f"WITH {S.deep()}, p AS (SELECT x, y, {select} FROM deep) " + S.out("p", "x, y", *channels))


_projection("add_channels", lambda i: H.add_channels(i, ["red", "mask_a"], ["mask_b"]), "red, 0e0 AS mask_a, 0e0 AS mask_b", ["red", "mask_a", "mask_b"])
register("remove_channels", lambda s, d: _every(H.remove_channels(tables.deep(s, d, ordered=False), ["red", "id"], ["pos_x", "pos_y", "pos_z"])), f"WITH {S.deep()} " + S.out("deep", "x, y", "front", "back", "alpha", "green", "blue"))
register("keep_channels", lambda s, d: _every(H.remove_channels(tables.deep(s, d, ordered=False), ["red"], operation="keep")), f"WITH {S.deep()} " + S.out("deep", "x, y", "front", "back", "alpha", "red"))
_projection("shuffle4", lambda i: H.shuffle4(i, ("green", "blue", None, "red"), ("red", "green", "blue", "red")), "red, blue AS green, 0e0 AS blue, alpha", ["red", "green", "blue", "alpha"])
_projection("shuffle_matrix", lambda i: H.shuffle(i, in2=("pos_x", "pos_y", "pos_z"), out2=("id",), matrix="out1:0:in1:2,out1:1:const:1,out1:0:in1:1,out2:0:in2:2,bad,out1:9:in1:0,out1:2:in2:0"), "blue AS red, 1e0 AS green, pos_x AS blue, alpha, pos_z AS id", ["red", "green", "blue", "alpha", "id"])


def _every(image: DeepImage) -> DataFrame:
    return millionths(image.df, ["x", "y"], [c for c in image.df.columns if c not in ("x", "y", "s")])


# filters
def _kept(name: str, fn, oracle: str, ordered: bool = True) -> None:
    register(name, lambda s, d: millionths(fn(tables.deep(s, d, ordered=ordered)).df, ["x", "y"], ["front", "back", *S.CORE]), oracle)


_ROWS = ("front", "back", *S.CORE)
_BOXED = lambda i: i.but(bbox=(10, 20, 50, 150))
_kept("adjust_bbox", lambda i: G.adjust_bbox(_BOXED(i), (-5, 10)), f"WITH {S.deep()} " + S.out("deep WHERE x >= 15 AND x < 45 AND y >= 10 AND y < 160", "x, y", *_ROWS), False)
_kept("copy_bbox", lambda i: G.copy_bbox(i, _BOXED(i)), f"WITH {S.deep()} " + S.out("deep WHERE x >= 10 AND x < 50 AND y >= 20 AND y < 150", "x, y", *_ROWS), False)
_kept("depth_clip", lambda i: T.depth_clip(i, 10, 40), f"WITH {S.deep()} " + S.out("deep WHERE front >= 10 AND front <= 40", "x, y", *_ROWS), False)
_kept("alpha_cull", lambda i: T.alpha_cull(i, 0.2), f"WITH {S.deep()} " + S.out("deep WHERE alpha > 2e-1", "x, y", *_ROWS), False)
_kept("occlusion_cutoff", lambda i: T.occlusion(i, 0.9), f"WITH {S.deep(ordered=True)}, {S.let_through('deep')} " + S.out("t WHERE 1e0 - t < 9e-1", "x, y", *_ROWS))
_kept("max_samples", lambda i: O.max_samples(i, 2), f"WITH {S.deep(ordered=True)}, r AS (SELECT *, row_number() OVER (PARTITION BY x, y {S.ORDER}) AS n FROM deep) " + S.out("r WHERE n <= 2", "x, y", *_ROWS))
_kept("contribution_cull", lambda i: T.contribution_cull(core(i), 0.3), f"WITH RECURSIVE {S.deep(ordered=True)}, {S.alive('deep', None, 0.3, None, None)} " + S.out("alive WHERE live", "x, y", *_ROWS))
_kept("volumetric_collapse", lambda i: T.volumetric_collapse(core(i), 0.6, 2), f"WITH {S.deep(ordered=True)}, {S.collapsed('deep', 0.6, 2)} " + S.out("kept", "x, y", *_ROWS))

# aggregates
_kept("flatten", lambda i: O.flatten(C.grade(core(i), **_GRADE)), f"WITH {S.deep(ordered=True)}, {S.UNPREMULT}, v AS (SELECT * REPLACE ({', '.join(f'({S.GRADE_SQL.replace("{v}", f"v_{c}")}) * alpha AS {c}' for c in RGB)}) FROM u), {S.composite('v', 'x, y')} " + S.out("c", "x, y", *_ROWS))
_MERGE = f"{S.grouped('{0}', 0.5, S.PREMULT_DIFFERS + S.num(0.3))}, gk AS (SELECT * EXCLUDE (n) FROM g{{1}}), {S.composite('gk', 'x, y, g')} "
_kept("smart_merge", lambda i: T.smart_merge(core(i), 0.5, 0.3), f"WITH RECURSIVE {S.deep(ordered=True)}, {_MERGE.format('deep', '')}" + S.out("c", "x, y", *_ROWS))
# a depth tolerance of 0 merges nothing, a colour tolerance of 0 lets all colours merge
_kept("smart_merge_zero_depth", lambda i: T.smart_merge(core(i), 0.0, 0.3), f"WITH {S.deep()} " + S.out("deep", "x, y", *_ROWS))
_NEAR = f"{S.grouped('deep', 0.5, 'FALSE')}, gk AS (SELECT * EXCLUDE (n) FROM g), {S.composite('gk', 'x, y, g')} "
_kept("smart_merge_zero_colour", lambda i: T.smart_merge(core(i), 0.5, 0.0), f"WITH RECURSIVE {S.deep(ordered=True)}, {_NEAR}" + S.out("c", "x, y", *_ROWS))
_THIN = T.Thinning(depth_clip=True, z_near=3, z_far=48, alpha_threshold=0.05, occlusion_alpha=0.97, contribution_min=0.02, volumetric_collapse=True, volume_alpha_max=0.5, volume_group_size=2, tolerance=0.5, color_tolerance=0.3, max_samples=3)
_THIN_SQL = f"WITH RECURSIVE {S.deep(ordered=True)}, {S.alive('deep', 0.97, 0.02, 0.05, (3, 48))}, al AS (SELECT * EXCLUDE (n) FROM alive), {S.collapsed('al', 0.5, 2, 'live')}, lv AS (SELECT x, y, s, front, back, alpha, red, green, blue FROM kept WHERE live), {_MERGE.format('lv', ' WHERE g < 3')}"
_kept("deep_thinner", lambda i: T.thin(core(i), _THIN), _THIN_SQL + S.out("c", "x, y", *_ROWS))
_PLAIN = f"WITH RECURSIVE {S.deep(ordered=True)}, {S.alive('deep', 0.999, 0.001, 0.0, None)}, lv AS (SELECT x, y, s, front, back, alpha, red, green, blue FROM alive WHERE live), {S.grouped('lv', 0.01, S.PREMULT_DIFFERS + S.num(0.01))}, gk AS (SELECT * EXCLUDE (n) FROM g), {S.composite('gk', 'x, y, g')} "
_kept("deep_thinner_default", lambda i: T.thin(core(i)), _PLAIN + S.out("c", "x, y", *_ROWS))


def _stats(s: SparkSession, d: str) -> DataFrame:
    image = core(tables.deep(s, d))
    return millionths(T.thin_stats(image, _THIN).drop("report"), ["samples_in", "samples_out", "removed"], ["pct"])


register("thinner_stats", _stats, _THIN_SQL + ", n AS (SELECT (SELECT count(*) FROM deep) AS i, (SELECT count(*) FROM c) AS o) SELECT CAST(i AS BIGINT) AS samples_in, CAST(o AS BIGINT) AS samples_out, CAST(i - o AS BIGINT) AS removed, " + S.q("(i - o) * 1e2 / i", "pct") + " FROM n")
_kept("tidy", lambda i: Y.tidy(core(i)), f"WITH {S.deep(ordered=True)}, {S.tidied('deep')} " + S.out("tidy", "x, y", *_ROWS))
_kept("optimize_samples", lambda i: Y.optimize_samples(core(i), 0.5, 0.2, 4), f"WITH RECURSIVE {S.deep(ordered=True)}, {S.optimised('deep', 0.5, 0.2, 4)} " + S.out("o", "x, y", *_ROWS))

_FIRST = f"r AS (SELECT *, row_number() OVER (PARTITION BY x, y {S.ORDER}) AS n FROM deep) "
_kept("optimize_zero", lambda i: Y.optimize_samples(core(i), 0.0, 0.2, 4), f"WITH {S.deep(ordered=True)}, {S.tidied('deep')}, r AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY front, back, s) AS n FROM tidy) " + S.out("r WHERE n <= 4", "x, y", *_ROWS))


# images without some channels: no alpha reads as opaque, colours are compared as far as they are there
def _without(*names: str):
    return lambda i: i.with_df(core(i).df.drop(*names))


_PART = ("front", "back", "red", "green", "blue")
register("flatten_no_alpha", lambda s, d: millionths(O.flatten(_without("alpha")(tables.deep(s, d))).df, ["x", "y"], list(_PART)), f"WITH {S.deep(ordered=True)}, {_FIRST}" + S.out("r WHERE n = 1", "x, y", *_PART))
register("thin_no_alpha", lambda s, d: millionths(T.thin(_without("alpha")(tables.deep(s, d))).df, ["x", "y"], list(_PART)), f"WITH {S.deep(ordered=True)}, {_FIRST}" + S.out("r WHERE n = 1", "x, y", *_PART))


# mattes
def _matte(name: str, fn, matte: str, operation: str = "{p}", more: str = "") -> None:
    made = [S.q(f"({operation.replace('{v}', f'v_{c}').replace('{p}', 'p')}) * alpha", c) for c in RGB]
    register(name, lambda s, d: millionths(fn(tables.deep(s, d, ordered=False)).df, ["x", "y"], ["front", "alpha", *RGB]), f"WITH {S.deep()}, {S.UNPREMULT}{more}, m AS (SELECT *, {matte} AS p FROM {'k' if more else 'u'}) SELECT x, y, {S.q('front', 'front')}, {S.q('alpha', 'alpha')}, {', '.join(made)} FROM m")


_ID = "CASE WHEN abs(CASE WHEN alpha <> 0 THEN id / alpha ELSE 0e0 END - 7e0) < 5e-1 THEN 1e0 ELSE 0e0 END"
_matte("id_matte", lambda i: M.id_matte(i, "id", 7), _ID)
for _op, _f in {"union": "{v} + {p} - {v} * {p}", "mask": "{v} * {p}", "stencil": "{v} * (1e0 - {p})", "out": "(1e0 - {v}) * {p}", "min": "least({v}, {p})", "max": "greatest({v}, {p})"}.items():
    _matte(f"matte_{_op}", lambda i, o=_op: M.id_matte(i, "id", 7, tolerance=2.5, operation=o), _ID.replace("5e-1", "25e-1"), _f)
_POS = ("pos_x", "pos_y", "pos_z")
_UP = ", k AS (SELECT *, " + ", ".join(f"CASE WHEN alpha <> 0 THEN {c} / alpha ELSE 0e0 END AS p_{c[-1]}" for c in _POS) + " FROM u)"
_SELECT = [[0.5, 0, 0, 0.1], [0, 0.75, 0, 0.2], [0, 0, 0.5, 0.4], [0, 0, 0, 1]]
_LOCAL = ("((p_x - 1e-1) / 5e-1)", "((p_y - 2e-1) / 75e-2)", "((p_z - 4e-1) / 5e-1)")
_SPHERE = f"greatest(least((1e0 - sqrt({' + '.join(f'{p} * {p}' for p in _LOCAL)})) / 8e-1, 1e0), 0e0)"
_CUBE = f"greatest(least(({' * '.join(f'greatest(least(1e0 - abs({p}), 1e0), 0e0)' for p in _LOCAL)}) / 8e-1, 1e0), 0e0)"
_SMOOTH = "({d} * {d} * (3e0 - 2e0 * {d}))"
_matte("position_matte_sphere", lambda i: M.position_matte(i, _POS, _SELECT, falloff=0.8, falloff_gamma=2), _SMOOTH.replace("{d}", f"sqrt({_SPHERE})"), more=_UP)
_matte("position_matte_cube", lambda i: M.position_matte(i, _POS, _SELECT, "cube", falloff=0.8), _SMOOTH.replace("{d}", _CUBE), more=_UP)
_matte("position_matte_linear", lambda i: M.position_matte(i, _POS, _SELECT, falloff_type="linear", falloff=0.8), _SPHERE, more=_UP)
for _type in ("simplex", "perlin", "value", "cubic", "cellular"):
    _noise = Noise(_type, frequency=4.0)
    register(
        f"noise_{_type}",
        lambda s, d, n=_noise: millionths(M.noise_matte(tables.deep(s, d, ordered=False), _POS, n, noise_evolution=0.3).df, ["x", "y"], ["front", "alpha", *RGB]),
        noise_matte(_noise, 0.3),
    )

_CAMERA = M.Camera([[1, 0, 0, 5], [0, 0, -1, 2], [0, 1, 0, 3], [0, 0, 0, 1]], 24.0, 18.0, 51.713, 90.0, (2.0, 0.5), (0.25, -0.5))


def _world(s: SparkSession, d: str) -> DataFrame:
    out = M.world_position(tables.deep(s, d, ordered=False), _CAMERA, depth_sample="average")
    return millionths(out.df, ["x", "y"], ["front", "world_x", "world_y", "world_z"])


# the inverse window: move by t, scale by s, turn back by -90 degrees; then the camera's rotation and place
_WORLD = f"""WITH {S.deep()}, n AS (SELECT *, (front + back) / 2e0 AS z, (x + 5e-1) / 64e0 * 2e0 - 1e0 AS nx, (y + 5e-1) / ((SELECT max(o_orderkey) FROM orders) // 64 + 1) * 2e0 - 1e0 AS ny FROM deep),
c AS (SELECT *, nx * (24e0 / 2e0 / 51.713e0) * z AS cx, ny * (18e0 / 2e0 / 51.713e0) * z AS cy, -z AS cz FROM n),
w AS (SELECT *, cy * 2e0 + 25e-2 AS wx, -cx * 5e-1 - 5e-1 AS wy FROM c),
o AS (SELECT x, y, front, (wx + 5e0) * alpha AS world_x, (-cz + 2e0) * alpha AS world_y, (wy + 3e0) * alpha AS world_z FROM w) {S.out("o", "x, y", "front", "world_x", "world_y", "world_z")}"""
register("world_position", _world, _WORLD)
for _which, _way in (("closest", ""), ("furthest", " DESC")):
    register(f"pick_{_which}", lambda s, d, w=_which: millionths(M.picks(tables.deep(s, d), ["id", "pos_z"], w).df, ["x", "y"], ["id", "pos_z"]), f"WITH {S.deep(ordered=True)}, r AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY front{_way}, back{_way}, s{_way}) AS n FROM deep) " + S.out("r WHERE n = 1", "x, y", "id", "pos_z"))


# keyed mixing
def _keymix(s: SparkSession, d: str, mask: bool = True) -> DataFrame:
    b, a = (core(tables.deep(s, d, f"l_linestatus = '{v}'")) for v in "OF")
    out = K.keymix(b, a, tables.mask(s, d) if mask else None, mix=0.9, invert_mask=True)
    return millionths(out.df, ["x", "y"], list(_ROWS))


_SIDES = f"{S.deep(chr(108) + '_linestatus = ' + chr(39) + 'O' + chr(39), True, 'b')}, {S.deep(chr(108) + '_linestatus = ' + chr(39) + 'F' + chr(39), True, 'a')}"
_KEYED = "(SELECT d.*, (1e0 - greatest(least(coalesce(m.value, 0e0), 1e0), 0e0)) * 9e-1 AS k FROM {0} d LEFT JOIN m ON d.x = m.x AND d.y = m.y)"
_MIXED = f"""WITH {_SIDES}, m AS ({tables.mask_sql()}),
o AS (SELECT x, y, front, back, {', '.join(f'CASE WHEN k <= 0 THEN {c} ELSE {c} * (1e0 - k) END AS {c}' for c in S.CORE)} FROM {_KEYED.format('b')} WHERE k < 1
  UNION ALL SELECT x, y, front, back, {', '.join(f'CASE WHEN k >= 1 THEN {c} ELSE {c} * k END AS {c}' for c in S.CORE)} FROM {_KEYED.format('a')} WHERE k > 0) """
register("keymix", _keymix, _MIXED + S.out("o", "x, y", *_ROWS))
register("keymix_bypass", lambda s, d: _keymix(s, d, False), f"WITH {_SIDES} " + S.out("b", "x, y", *_ROWS))

# blurs
for _fall in ("linear", "gaussian", "smoothstep", "exponential"):
    _kept(f"depth_blur_{_fall}", lambda i, f=_fall: D.depth_blur(core(i), 2.0, 5, f), f"WITH {S.deep(ordered=True)}, {S.depth_blurred('deep', 2.0, 5, _fall)} " + S.out("db", "x, y", *_ROWS))
_kept("depth_blur_flat", lambda i: D.depth_blur(core(i), 2.0, 4, "gaussian", "flat"), f"WITH {S.deep(ordered=True)}, {S.depth_blurred('deep', 2.0, 4, 'gaussian', True)} " + S.out("db", "x, y", *_ROWS))


def _gated(s: SparkSession, d: str) -> DataFrame:
    gate = tables.deep(s, d, "l_returnflag = 'R'", ordered=False)
    return millionths(D.depth_blur(core(tables.deep(s, d)), 2.0, 5, "gaussian", gate=gate).df, ["x", "y"], list(_ROWS))


register("depth_blur_gated", _gated, f"WITH {S.deep(ordered=True)}, gate AS ({tables.deep_sql(chr(108) + '_returnflag = ' + chr(39) + 'R' + chr(39), False)}), {S.depth_blurred('deep', 2.0, 5, 'gaussian', gate='gate')} " + S.out("db", "x, y", *_ROWS))
_TOL = (0.05, 0.05, 20)


def _blur_sql(width: float, height: float, quality: str, corrected: bool = False) -> str:
    made = f"WITH RECURSIVE {S.deep(ordered=True)}, {S.scattered('deep', width, height, quality)}, {S.optimised('sc', _TOL[0], _TOL[1], _TOL[2])}"
    if corrected:
        let = f"1e0 - coalesce(sum(alpha) OVER (PARTITION BY x, y {S.ORDER} {S.BEFORE}), 0e0)"
        made += f", lt AS (SELECT *, {let} AS l FROM o), o2 AS (SELECT x, y, front, back, {', '.join(f'{c} / CASE WHEN l > 1e-6 THEN l ELSE 1e0 END AS {c}' for c in S.CORE)} FROM lt)"
    return made + " " + S.out("o2" if corrected else "o", "x, y", *_ROWS)


_kept("blur", lambda i: B.blur(core(i), 1, 1, _TOL[2], _TOL[0], _TOL[1]), _blur_sql(1, 1, "medium"))
for _quality in ("low", "medium", "high"):
    _kept(f"blur2_{_quality}", lambda i, k=_quality: B.blur2(core(i), (2, 0), k, False, _TOL[2], _TOL[0], _TOL[1]), _blur_sql(2, 0, _quality))
_kept("blur2_2d", lambda i: B.blur2(core(i), (1, 2), "high", False, _TOL[2], _TOL[0], _TOL[1]), _blur_sql(1, 2, "high"))
_ONE = ("alpha", "green")
register(
    "blur_single_channel",
    lambda s, d: millionths(B.blur(_without("red", "blue")(tables.deep(s, d)), 1, 0, _TOL[2], _TOL[0], _TOL[1]).df, ["x", "y"], ["front", "back", *_ONE]),
    f"WITH RECURSIVE {S.deep(ordered=True)}, {S.scattered('deep', 1, 0, 'medium', _ONE)}, {S.optimised('sc', *_TOL, channels=_ONE)} " + S.out("o", "x, y", "front", "back", *_ONE),
)
_kept("blur2_alpha_correction", lambda i: B.blur2(core(i), (1, 0), "medium", True, _TOL[2], _TOL[0], _TOL[1]), _blur_sql(1, 0, "medium", True))


# boxes asked of chains, pixels that are cut, picks as parameters, table functions
_BOX = (10, 5, 50, 40)
_IN_BOX = "x >= 10 AND x < 50 AND y >= 5 AND y < 40"
_kept("box_of_blur", lambda i: G.crop(B.blur2(core(i), (2, 0), "medium", False, _TOL[2], _TOL[0], _TOL[1]), _BOX), _blur_sql(2, 0, "medium") + f" WHERE {_IN_BOX}")
_kept("flatten_in_ranges", lambda i: O.flatten(C.grade(core(i), **_GRADE), most=3), ORACLES["flatten"])


def _table_function(name: str, call: str, oracle: str) -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        table_functions.register(s)
        core(tables.deep(s, d)).df.createOrReplaceTempView("lamella_samples")
        return millionths(s.sql(f"SELECT * FROM {call}"), ["x", "y"], list(_ROWS))

    register(name, query, oracle)


_table_function("sql_thin", "deep_thin(TABLE(lamella_samples))", ORACLES["deep_thinner_default"])
_table_function("sql_tidy", "deep_tidy(TABLE(lamella_samples))", ORACLES["tidy"])
_table_function("sql_merge", "deep_merge(TABLE(lamella_samples), tolerance => 0.5D, color_tolerance => 0.3D)", ORACLES["smart_merge"])


def _pick_sql(column: str) -> str:
    return f"(SELECT CASE WHEN alpha <> 0 THEN {column} / alpha ELSE 0e0 END FROM o WHERE x = 1 AND y = 0 ORDER BY front, back, s LIMIT 1)"


def _picked(name: str, fn, matte: str, more: str = "") -> None:
    made = [S.q("p * alpha", c) for c in RGB]
    source = f"WITH {S.deep()}, {S.deep(ordered=True, name='o')}, {S.UNPREMULT}{more}, m AS (SELECT *, {matte} AS p FROM {'k' if more else 'u'})"
    register(name, lambda s, d: millionths(fn(tables.deep(s, d, ordered=False), tables.deep(s, d)).df, ["x", "y"], ["front", "alpha", *RGB]), f"{source} SELECT x, y, {S.q('front', 'front')}, {S.q('alpha', 'alpha')}, {', '.join(made)} FROM m")


_picked("picked_id_matte", lambda i, o: M.id_matte(i, "id", M.picked_id(o, 1, 0, "id"), tolerance=1.5), _ID.replace("7e0", _pick_sql("id")).replace("5e-1", "15e-1"))
_FROM = " + ".join(f"pow((p_{c[-1]} - {_pick_sql(c)}) / 5e-1, 2)" for c in _POS)
_picked("picked_position_matte", lambda i, o: M.position_matte(i, _POS, np.diag([0.5, 0.5, 0.5, 1.0]), falloff_type="linear", falloff=0.8, centre=M.picked_centre(o, 1, 0, _POS)), f"greatest(least((1e0 - sqrt({_FROM})) / 8e-1, 1e0), 0e0)", _UP)

# own operators, colours by example, routing that changes nothing, the box that keyed mixing declares
_colour("map_channels", lambda i: C.map_channels(i, lambda c, v, a: v * v + a * 0.1), S.colour("{v} * {v} + alpha * 1e-1"))
_EXAMPLE = {"red": (0.5, 0.7), "green": (0.2, 0.3), "blue": (0.4, 0.2)}
_colour(
    "set_rgb",
    lambda i: C.color_lookup(i, **C.set_rgb(*zip(*_EXAMPLE.values(), strict=True))),
    S.colour(*[f"CASE WHEN {{v}} < {a}e0 THEN {{v}} * ({b}e0 / {a}e0) ELSE {b}e0 + ({{v}} - {a}e0) * ((1e0 - {b}e0) / (1e0 - {a}e0)) END" for a, b in _EXAMPLE.values()]),
)
_projection("shuffle_identity", lambda i: H.shuffle(i, matrix=""), "red, green, blue, alpha", ["red", "green", "blue", "alpha"])


def _keymix_box(s: SparkSession, d: str) -> DataFrame:
    b, a = (core(tables.deep(s, d, f"l_linestatus = '{v}'")) for v in "OF")
    out = K.keymix(b, G.crop(a, _BOX), tables.mask(s, d), mix=0.9, invert_mask=True, bbox="A")
    return millionths(G.copy_bbox(out).df, ["x", "y"], list(_ROWS))


register("keymix_box", _keymix_box, _MIXED + S.out(f"o WHERE {_IN_BOX}", "x, y", *_ROWS))


# generator
def _constant_sql(mode: str) -> str:
    n = 4

    def end(v: float) -> str:
        return {"uniform": f"{v}", "additive": f"{v} / 4e0", "multiplicative": f"{v} / {v} * (1e0 - pow(1e0 - {v}, 25e-2))"}[mode]

    value = f"(s * 25e-1 / 1e1) * ({end(0.5)}) + (1e0 - s * 25e-1 / 1e1) * ({end(0.2)})"
    return f"WITH p AS (SELECT i % 32 AS x, i // 32 AS y, s FROM range(32 * 16) a(i), range({n}) b(s)), o AS (SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, s * 25e-1 AS front, (s + 1) * 25e-1 AS back, {value} AS red, {value} AS alpha FROM p) " + S.out("o", "x, y", "front", "back", "red", "alpha")


for _how in ("uniform", "additive", "multiplicative"):
    register(f"constant_{_how}", lambda s, d, m=_how: millionths(constant(s, (32, 16), samples=4, alpha_mode=m).df, ["x", "y"], ["front", "back", "red", "alpha"]), _constant_sql(_how))
