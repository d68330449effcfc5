"""SQL that states the noises anew, in stages of plain arithmetic over literal tables, for a second engine to check the queries against."""

from __future__ import annotations

import itertools

import numpy as np

from ..functions.noise import Noise, default_values, default_vectors, gradients, permutation
from .sql import RGB, deep, num, out

_AXES = range(4)
_BASE = "x, y, front, alpha, q0, q1, q2, q3, acc"


def _listed(values) -> str:
    return "[" + ", ".join(str(int(v)) if isinstance(v, (int, np.integer)) else num(float(v)) for v in values) + "]"


def _floor(p: str) -> str:
    return f"CAST(CASE WHEN {p} >= 0e0 THEN trunc({p}) ELSE trunc({p}) - 1e0 END AS BIGINT)"


def _stages(source: str, prefix: str, steps: list[list[str]]) -> tuple[str, str]:
    """CTEs that each add columns to the one before; their text and the last one's name."""
    made = []
    for i, columns in enumerate(steps):
        made.append(f"{prefix}{i} AS (SELECT *, {', '.join(columns)} FROM {source})")
        source = f"{prefix}{i}"
    return ", ".join(made), source


def _lookups(offset: int, steps: tuple[int, ...]) -> list[list[str]]:
    """Stages up to the sums of all cells around, named by their steps from x to w."""
    name = lambda done: "s" + "".join("m" if k < 0 else str(k) for k in done)
    level, stages = [()], []
    for axis in reversed(_AXES):
        columns, following = [], []
        for done in level:
            index = str(offset) if not done else f"P[{name(done)} + 1]"
            for k in steps:
                columns.append(f"((c{axis} + {k}) & 255) + {index} AS {name((k, *done))}")
                following.append((k, *done))
        stages.append(columns)
        level = following
    return stages


def _corner(k: tuple[int, ...]) -> str:
    return "s" + "".join("m" if i < 0 else str(i) for i in k)


def _interpolated(value) -> list[list[str]]:
    """Stages that interpolate the corners' ``value(steps)`` along x, then y, z and w; the result is ``n``."""
    stages = [[f"f{a} * f{a} * f{a} * (f{a} * (f{a} * 6e0 - 15e0) + 10e0) AS t{a}" for a in _AXES]]
    term = value
    for axis in _AXES:
        rest = list(itertools.product((0, 1), repeat=3 - axis))
        label = lambda k, axis=axis: f"i{axis}_" + "".join(map(str, k))
        stages.append([f"{term((0, *k))} + t{axis} * ({term((1, *k))} - {term((0, *k))}) AS {label(k) if rest != [()] else 'n'}" for k in rest])
        term = lambda k, label=label: label(k)
    return stages


_CELL = [[f"{_floor(f'q{a}')} AS c{a}" for a in _AXES], [f"q{a} - c{a} AS f{a}" for a in _AXES]]


def _value(offset: int) -> list[list[str]]:
    return _CELL + _lookups(offset, (0, 1)) + _interpolated(lambda k: f"V[{_corner(k)} + 1]")


def _perlin(offset: int) -> list[list[str]]:
    dots = [f"{' + '.join(f'G{a}[{_corner(k)} + 1] * (f{a} - {k[a]}e0)' for a in _AXES)} AS g{_corner(k)}" for k in itertools.product((0, 1), repeat=4)]
    return _CELL + _lookups(offset, (0, 1)) + [dots] + _interpolated(lambda k: f"g{_corner(k)}")


def _simplex(offset: int) -> list[list[str]]:
    skew, unskew = num((5**0.5 - 1) / 4), num((1 - 5**-0.5) / 4)
    stages = [[f"(q0 + q1 + q2 + q3) * {skew} AS sk"], [f"{_floor(f'q{a} + sk')} AS c{a}" for a in _AXES], [f"q{a} - (c{a} - (c0 + c1 + c2 + c3) * {unskew}) AS o{a}" for a in _AXES]]
    ranks = []
    for a in _AXES:
        won = [f"CAST(o{a} > o{b} AS INTEGER)" if a < b else f"CAST(NOT o{b} > o{a} AS INTEGER)" for b in _AXES if b != a]
        ranks.append(f"{' + '.join(won)} AS r{a}")
    stages.append(ranks)
    parts = []
    for corner in range(5):
        stages.append([f"CAST(r{a} >= {4 - corner} AS INTEGER) AS e{corner}{a}" for a in _AXES])
        stages.append([f"o{a} - e{corner}{a} + {corner}e0 * {unskew} AS d{corner}{a}" for a in _AXES])
        index = str(offset)
        for a in reversed(_AXES):
            stages.append([f"((c{a} + e{corner}{a}) & 255) + {index} AS k{corner}{a}"])
            index = f"P[k{corner}{a} + 1]"
        stages.append([f"greatest(6e-1 - ({' + '.join(f'd{corner}{a} * d{corner}{a}' for a in _AXES)}), 0e0) AS l{corner}", f"{' + '.join(f'G{a}[k{corner}0 + 1] * d{corner}{a}' for a in _AXES)} AS v{corner}"])
        parts.append(f"l{corner} * l{corner} * l{corner} * l{corner} * v{corner}")
    return [*stages, [f"({' + '.join(parts)}) * 27e0 AS n"]]


def _cubic(offset: int) -> list[list[str]]:
    steps = (-1, 0, 1, 2)
    weight = {-1: "2e0 * f{0} * f{0} - f{0} * f{0} * f{0} - f{0}", 0: "f{0} * f{0} * f{0} - 2e0 * f{0} * f{0} + 1e0", 1: "f{0} * f{0} - f{0} * f{0} * f{0} + f{0}", 2: "f{0} * f{0} * f{0} - f{0} * f{0}"}
    stages = [*_CELL, *_lookups(offset, steps), [f"{weight[k].format(a)} AS t{a}_{_corner((k,))}" for a in _AXES for k in steps]]
    term = lambda k: f"V[{_corner(k)} + 1]"
    for axis in _AXES:
        rest = list(itertools.product(steps, repeat=3 - axis))
        label = lambda k, axis=axis: f"i{axis}_{_corner(k)}"
        stages.append([f"{' + '.join(f't{axis}_{_corner((i,))} * {term((i, *k))}' for i in steps)} AS {label(k)}" for k in rest])
        term = lambda k, label=label: label(k)
    return [*stages, [f"{term(())} / {num(1.5**4)} AS n"]]


_ONE = {"cubic": _cubic, "value": _value, "perlin": _perlin, "simplex": _simplex}


def _cellular(noise: Noise) -> str:
    """The hash of the nearest cell: all 81 cells of a point beside each other, the first of the nearest taken."""
    nearest = [f"CAST(CASE WHEN q{a} >= 0e0 THEN trunc(q{a} + 5e-1) ELSE trunc(q{a} - 5e-1) END AS BIGINT) AS c{a}" for a in _AXES]
    cells = [c[::-1] for c in itertools.product((-1, 0, 1), repeat=4)]
    values = ", ".join(f"({i}, {', '.join(map(str, c))})" for i, c in enumerate(cells))
    index, chain = "0", []
    for a in reversed(_AXES):
        chain.append([f"((c{a} + e{a}) & 255) + {index} AS k{a}"])
        index = f"P[k{a} + 1]"
    chain.append([f"c{a} - q{a} + e{a} + G{a}[k0 + 1] AS d{a}" for a in _AXES])
    chain.append([f"{' + '.join(f'd{a} * d{a} + abs(d{a})' for a in _AXES)} AS d"])
    stages, last = _stages("wide", "w", chain)
    word = lambda e: f"((({e}) % 4294967296 + 4294967296) % 4294967296)"
    mixed = f"{noise.seed}"
    for a, prime in zip(_AXES, (1619, 31337, 6971, 1013), strict=True):
        mixed = f"xor({mixed}, CAST({word(f'b{a} * {prime}')} AS BIGINT))"
    square = word("CAST(h AS HUGEINT) * h")
    whole = word(f"{word(f'{square} * h')} * 60493")
    return f"""point AS (SELECT *, row_number() OVER () AS id, {', '.join(nearest)} FROM base),
wide AS (SELECT * FROM point CROSS JOIN (VALUES {values}) cell(i, e0, e1, e2, e3)), {stages},
best AS (SELECT id, any_value(x) AS x, any_value(y) AS y, any_value(front) AS front, any_value(alpha) AS alpha, arg_min([c0 + e0, c1 + e1, c2 + e2, c3 + e3], d * 1e0 + i * 0e0) AS b FROM {last} GROUP BY id),
mixed AS (SELECT *, b[1] AS b0, b[2] AS b1, b[3] AS b2, b[4] AS b3 FROM best), hashed AS (SELECT *, {mixed} AS h FROM mixed),
o AS (SELECT x, y, front, alpha, {whole} AS u FROM hashed), noised AS (SELECT x, y, front, alpha, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END / 2147483648e0 AS acc FROM o)"""


def noise_matte(noise: Noise, evolution: float) -> str:
    """A matte of the noise at the samples' positions, with its default grade."""
    perm = permutation(noise.seed)
    place = [f"CASE WHEN alpha <> 0 THEN pos_{c} / alpha ELSE 0e0 END" for c in "xyz"] + [num(evolution)]
    tables = {"P": perm}
    if noise.type in ("value", "cubic"):
        tables["V"] = default_values()[perm]
    elif noise.type == "cellular":
        tables |= {f"G{a}": (default_vectors() * noise.jitter)[perm][:, a] for a in _AXES}
    else:
        tables |= {f"G{a}": gradients()[perm % 32][:, a].astype(int) for a in _AXES}
    lists = ", ".join(f"{_listed(v)} AS {n}" for n, v in tables.items())
    base = f"WITH {deep()}, tab AS (SELECT {lists}), base AS (SELECT x, y, front, alpha, {', '.join(f'({e}) * {num(noise.frequency)} AS q{a}' for a, e in enumerate(place))}, 0e0 AS acc, tab.* FROM deep CROSS JOIN tab)"
    if noise.type == "cellular":
        text = f"{base}, {_cellular(noise)}"
    else:
        layers, own = 1 if noise.type in ("value", "cubic") else noise.octaves, noise.type == "simplex"
        source, text, amp = "base", base, 1.0
        for i in range(layers):
            # a four-dimensional simplex begins at offset 0 and scales its first octave once more
            offset = 0 if noise.type in ("value", "cubic") or own and not i else int(perm[i])
            scaled = f"SELECT * REPLACE ({', '.join(f'q{a} * {num(noise.frequency if own and not i else 1.0)} AS q{a}' for a in _AXES)}) FROM {source}"
            stages, last = _stages(f"oct{i}", f"o{i}_", _ONE[noise.type](offset))
            kept = ", ".join(f"q{a} {f'/ {num(noise.frequency)}' if own and not i else ''} * {num(noise.lacunarity)} AS q{a}" for a in _AXES)
            text += f", oct{i} AS ({scaled}), {stages}, sum{i} AS (SELECT x, y, front, alpha, {kept}, acc + n * {num(amp)} AS acc, {', '.join(tables)} FROM {last})"
            source, amp = f"sum{i}", amp * noise.gain
        bounding = 1.0 if noise.type in ("value", "cubic") else noise.bounding
        text += f", noised AS (SELECT x, y, front, alpha, acc * {num(bounding)} AS acc FROM {source})"
    made = ", ".join(f"(acc * 5e-1 + 5e-1) * alpha AS {c}" for c in RGB)
    return f"{text}, matte AS (SELECT x, y, front, alpha, {made} FROM noised) " + out("matte", "x, y", "front", "alpha", *RGB)
