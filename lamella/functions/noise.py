"""Lattice noise in two to four dimensions over numpy arrays: value, gradient (Perlin), simplex, cubic, cellular and white, with
fractal sums and coordinate warps.

All families index a permutation that is drawn from a 64-bit Mersenne Twister. The 32 gradients follow a rule. The 256 lattice
values and feature vectors are drawn by a rule too (evenly spread values, random unit vectors); a caller who needs those of
another implementation passes them as ``values`` and ``vectors``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1
_BLOCK = 8192
TYPES = ("simplex", "cellular", "cubic", "perlin", "value", "white")
FRACTALS = ("fbm", "billow", "rigid", "blend")
DISTANCES = ("natural", "euclidean", "manhattan")
RETURNS = ("cell_value", "noise_lookup", "distance", "distance2", "distance2_add", "distance2_sub", "distance2_mul", "distance2_div")


def mersenne64(seed: int, count: int) -> list[int]:
    """The first numbers of the 64-bit Mersenne Twister (published parameters)."""
    n, m, upper, lower = 312, 156, _MASK ^ 0x7FFFFFFF, 0x7FFFFFFF
    state = [seed & _MASK]
    for i in range(1, n):
        state.append((6364136223846793005 * (state[-1] ^ (state[-1] >> 62)) + i) & _MASK)
    out: list[int] = []
    while len(out) < count:
        for i in range(n):
            x = (state[i] & upper) | (state[(i + 1) % n] & lower)
            state[i] = state[(i + m) % n] ^ (x >> 1) ^ (0xB5026F5AA96619E9 if x & 1 else 0)
        for x in state:
            x ^= (x >> 29) & 0x5555555555555555
            x ^= (x << 17) & 0x71D67FFFEDA60000
            x ^= (x << 37) & 0xFFF7EEE000000000
            out.append(x ^ (x >> 43))
    return out[:count]


@cache
def permutation(seed: int) -> np.ndarray:
    """0..255 shuffled, twice over."""
    perm = list(range(256))
    for j, r in enumerate(mersenne64(seed, 256)):
        k = j + r % (256 - j)
        perm[j], perm[k] = perm[k], perm[j]
    return np.array(perm * 2, np.int64)


@cache
def gradients(dims: int = 4) -> np.ndarray:
    """In four dimensions the 32 vectors with one 0 and three of 1 or -1: the place of the 0 moves from first to last, and the
    signs vary slowest in front. Else the 12 edges of a cube: the place of the 0 moves from last to first, and the signs vary
    slowest at the end; in two dimensions without their last coordinate."""
    out = []
    if dims == 4:
        for zero in range(4):
            for signs in itertools.product((1, -1), repeat=3):
                v = list(signs)
                v.insert(zero, 0)
                out.append(v)
    else:
        for zero in (2, 1, 0):
            for second, first in itertools.product((1, -1), repeat=2):
                v = [first, second]
                v.insert(zero, 0)
                out.append(v)
    return np.array(out, float)[:, :dims]


@cache
def _gradient_columns(dims: int, seed: int) -> tuple[np.ndarray, ...]:
    """Each coordinate of the gradient that a sum of cell and index leads to: the last lookup in the permutation, taken beforehand."""
    made = gradients(dims)
    return tuple(np.ascontiguousarray(c) for c in made[permutation(seed) % len(made)].T)


def _dot(columns: tuple[np.ndarray, ...], at: np.ndarray, off) -> np.ndarray:
    total = columns[0].take(at, mode="clip")
    total *= off[0]
    for c, o in zip(columns[1:], off[1:], strict=True):
        part = c.take(at, mode="clip")
        part *= o
        total += part
    return total


@cache
def default_values(seed: int = 1) -> np.ndarray:
    spread = (2 * np.arange(256) - 255) / 255
    return spread[np.random.default_rng(seed).permutation(256)]


@cache
def default_vectors(dims: int = 4, seed: int = 2) -> np.ndarray:
    v = np.random.default_rng(seed).normal(size=(256, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _fade(t: np.ndarray, interpolation: str) -> np.ndarray:
    if interpolation == "linear":
        return t
    return t * t * (3 - 2 * t) if interpolation == "hermite" else t * t * t * (t * (t * 6 - 15) + 10)


def _floor(p: np.ndarray) -> np.ndarray:
    """Towards minus infinity, but one lower at negative whole numbers."""
    out = p.astype(np.int64)
    out -= p < 0
    return out


def lattice_hash(seed: int, cell: np.ndarray) -> np.ndarray:
    """A value in -1..1 from a cell's coordinates (axis 0), in 32-bit arithmetic that wraps."""
    with np.errstate(over="ignore"):
        n = np.full(cell.shape[1:], seed, np.int32)
        for c, prime in zip(cell, (1619, 31337, 6971, 1013), strict=False):
            n ^= c.astype(np.int32) * np.int32(prime)
        return (n * n * n * np.int32(60493)).astype(float) / 2147483648.0


@dataclass(frozen=True)
class Noise:
    """Settings of a noise; ``column`` makes it an expression, ``at`` evaluates it on arrays."""

    type: str = "simplex"
    fractal: str = "fbm"
    frequency: float = 0.5
    octaves: int = 5
    lacunarity: float = 2.0
    gain: float = 0.5
    distance: str = "natural"
    returns: str = "cell_value"
    index0: int = 0
    index1: int = 1
    jitter: float = 0.45
    seed: int = 1337
    interpolation: str = "quintic"
    #: The noise whose value at the nearest feature a cellular noise returns as ``noise_lookup``.
    lookup: Noise | None = None
    #: Octaves for the families that are single-octave in a matte (value, cubic).
    layered: bool = False
    values: np.ndarray | None = field(default=None, compare=False)
    vectors: np.ndarray | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        for name, allowed in (("type", TYPES), ("fractal", FRACTALS), ("distance", DISTANCES), ("returns", RETURNS)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} {getattr(self, name)}")
        if self.returns == "noise_lookup" and self.lookup is None:
            raise ValueError("noise_lookup needs a lookup")

    def column(self, *coordinates: Column) -> Column:
        noise = self

        @F.pandas_udf("double")
        def f(p: pd.DataFrame) -> pd.Series:
            return pd.Series(noise.at(p.to_numpy(float).T.copy()))

        return f(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(coordinates)]))

    def at(self, p: np.ndarray) -> np.ndarray:
        """Noise at points, axis 0 of ``p`` being x, y and maybe z, w; worked on in blocks that stay in the cache."""
        p = np.asarray(p, float)
        if not 2 <= len(p) <= 4 or self.fractal == "blend" and len(p) != 2:
            raise ValueError(f"{self.fractal} noise in {len(p)} dimensions")
        flat = p.reshape(len(p), -1)
        if flat.shape[1] > _BLOCK:
            parts = [self._block(flat[:, i : i + _BLOCK] * self.frequency) for i in range(0, flat.shape[1], _BLOCK)]
            return np.concatenate(parts).reshape(p.shape[1:])
        return self._block(p * self.frequency)

    def _block(self, p: np.ndarray) -> np.ndarray:
        if self.type == "white":
            return lattice_hash(self.seed, p.view(np.int64) ^ (p.view(np.int64) >> 32))
        if self.type == "cellular":
            return self._cellular(p)
        single: Callable = {"simplex": self._simplex, "perlin": self._perlin, "value": self._value, "cubic": self._cubic}[self.type]
        if self.type in ("value", "cubic") and not self.layered:
            return single(0, p)
        return self._fractal(single, p)

    def _fractal(self, single: Callable, p: np.ndarray) -> np.ndarray:
        """Four-dimensional simplex starts at offset 0 and, unless rigid, scales its first octave by the frequency once more; all
        else starts at the permutation's first entry."""
        perm = permutation(self.seed)
        own, rigid = self.type == "simplex" and len(p) == 4, self.fractal == "rigid"
        first = p * self.frequency if own and not rigid else p
        shape = {"fbm": lambda n: n, "billow": lambda n: np.abs(n) * 2 - 1, "rigid": lambda n: 1 - np.abs(n), "blend": lambda n: n}[self.fractal]
        total = shape(single(0 if own else int(perm[0]), first))
        amp = 1.0
        for i in range(1, self.octaves):
            p, amp = p * self.lacunarity, amp * self.gain
            n = shape(single(int(perm[i]), p)) * amp
            total = total * (n + 1) if self.fractal == "blend" else total - n if rigid else total + n
        return total if rigid else total * self.bounding

    @property
    def bounding(self) -> float:
        """What brings a sum of octaves back to the range of one."""
        return 1 / sum(self.gain**i for i in range(max(self.octaves, 1)))

    def warped(self, p: np.ndarray, amplitude: float = 1.0, octaves: int = 1) -> np.ndarray:
        """Points moved by smooth random vectors: by one octave, or by several, each moving what the one before has moved."""
        p = np.array(p, float)
        dims, perm = len(p), permutation(self.seed)
        columns = [np.ascontiguousarray(c) for c in (default_vectors(dims) if self.vectors is None else self.vectors)[perm].T]
        amp = amplitude if octaves == 1 else amplitude / sum(self.gain**i for i in range(octaves))
        frequency = self.frequency
        for i in range(octaves):
            q = p * frequency
            cell = _floor(q)
            sums = self._tree(0 if octaves == 1 else int(perm[i]), cell, (0, 1))
            p = p + amp * np.stack([self._corners(q, cell, {k: c.take(at, mode="clip") for k, at in sums.items()}) for c in columns])
            frequency, amp = frequency * self.lacunarity, amp * self.gain
        return p

    def _sum(self, offset: int, cell: np.ndarray) -> np.ndarray:
        """What the permutation's entry is the index of a cell: the sum that its first coordinate ends with."""
        perm = permutation(self.seed)
        at = np.full(cell.shape[1:], offset, np.int64)
        for axis in reversed(range(len(cell))):
            at = (cell[axis] & 255) + (at if axis == len(cell) - 1 else perm.take(at, mode="clip"))
        return at

    def _tree(self, offset: int, cell: np.ndarray, steps: tuple[int, ...]) -> dict[tuple, np.ndarray]:
        """The sums of every cell around ``cell``, by its steps (x, y, z, w). What neighbours share is looked up once."""
        perm = permutation(self.seed)
        level: dict[tuple, np.ndarray | int] = {(): offset}
        for axis in reversed(range(len(cell))):
            places = [(k, (cell[axis] + k) & 255) for k in steps]
            level = {(k, *done): c + at for done, at in level.items() for k, c in places}
            if axis:
                level = {k: perm.take(at, mode="clip") for k, at in level.items()}
        return level

    def _corners(self, p: np.ndarray, cell: np.ndarray, corners: dict[tuple, np.ndarray]) -> np.ndarray:
        """Interpolated between ``corners``, which are used up."""
        fade = _fade(p - cell, self.interpolation)
        for axis in range(len(p)):
            made = {}
            for k in corners:
                if k[0] == 0:
                    a, b = corners[k], corners[(1, *k[1:])]
                    b -= a
                    b *= fade[axis]
                    b += a
                    made[k[1:]] = b
            corners = made
        return corners[()]

    def _values(self) -> np.ndarray:
        """The lattice value that a sum of cell and index leads to."""
        return (default_values() if self.values is None else self.values)[permutation(self.seed)]

    def _value(self, offset: int, p: np.ndarray) -> np.ndarray:
        table, cell = self._values(), _floor(p)
        return self._corners(p, cell, {k: table.take(at, mode="clip") for k, at in self._tree(offset, cell, (0, 1)).items()})

    def _perlin(self, offset: int, p: np.ndarray) -> np.ndarray:
        cell = _floor(p)
        off = p - cell
        sides, columns = [(o, o - 1) for o in off], _gradient_columns(len(p), self.seed)
        return self._corners(p, cell, {k: _dot(columns, at, [sides[a][k[a]] for a in range(len(p))]) for k, at in self._tree(offset, cell, (0, 1)).items()})

    def _simplex(self, offset: int, p: np.ndarray) -> np.ndarray:
        dims = len(p)
        skew, unskew = ((dims + 1) ** 0.5 - 1) / dims, (1 - (dims + 1) ** -0.5) / dims
        reach, scale = (0.5 if dims == 2 else 0.6), {2: 70, 3: 32, 4: 27}[dims]
        cell = _floor(p + p.sum(0) * skew)
        origin = p - (cell - cell.sum(0) * unskew)
        # rank of each offset: how many of the others it comes after; of equal ones the later axis does, in three dimensions the earlier
        rank = np.zeros(origin.shape, np.int64)
        for i, j in itertools.combinations(range(dims), 2):
            greater = origin[i] >= origin[j] if dims == 3 else origin[i] > origin[j]
            rank[i] += greater
            rank[j] += ~greater
        total, columns = np.zeros(p.shape[1:]), _gradient_columns(dims, self.seed)
        for corner in range(dims + 1):
            step = (rank >= dims - corner).astype(np.int64)
            off = origin - step + corner * unskew
            fall = reach - np.einsum("i...,i...->...", off, off)
            np.maximum(fall, 0, out=fall)
            fall *= fall
            fall *= fall
            fall *= _dot(columns, self._sum(offset, cell + step), off)
            total += fall
        return total * scale

    def _cubic(self, offset: int, p: np.ndarray) -> np.ndarray:
        table, cell = self._values(), _floor(p)
        t = p - cell
        # the cubic through four values in a row, as their weights
        two, three = t * t, t * t * t
        weights = (2 * two - three - t, three - 2 * two + 1, two - three + t, three - two)
        perm, places = permutation(self.seed), [[(c + k) & 255 for k in (-1, 0, 1, 2)] for c in cell]

        def along(axis: int, index: np.ndarray | int) -> np.ndarray:
            """The cubic along an axis through what the axes before it give, one lattice line at a time."""
            total = None
            for place, weight in zip(places[axis], weights, strict=True):
                at = place + index
                part = along(axis - 1, perm.take(at, mode="clip")) if axis else table.take(at, mode="clip")
                part *= weight[axis]
                if total is None:
                    total = part
                else:
                    total += part
            return total

        return along(len(p) - 1, offset) / 1.5 ** len(p)

    def _cellular(self, p: np.ndarray) -> np.ndarray:
        dims = len(p)
        table = default_vectors(dims) if self.vectors is None else self.vectors
        centre = np.where(p >= 0, np.trunc(p + 0.5), np.trunc(p - 0.5)).astype(np.int64)
        shape = p.shape[1:]
        i0, i1 = sorted(min(max(i, 0), 3) for i in (self.index0, self.index1))
        which = self.returns in ("cell_value", "noise_lookup")
        depth = 0 if which or self.returns == "distance" else i1
        nearest = np.full((depth + 1, *shape), 999999.0)
        best = np.zeros(shape, np.int64)
        columns = [np.ascontiguousarray(c) * self.jitter for c in table[permutation(self.seed)].T]
        sums, near = self._tree(0, centre, (-1, 0, 1)), centre - p
        moved = [{k: near[axis] + k for k in (-1, 0, 1)} for axis in range(dims)]
        # in four dimensions the last axis is outermost, else the first: of equally near features the first found counts
        cells = [c[::-1] if dims == 4 else c for c in itertools.product((-1, 0, 1), repeat=dims)]
        off, part = np.empty(shape), np.empty(shape)
        for n, steps in enumerate(cells):
            at, d = sums[steps], np.zeros(shape)
            for axis, k in enumerate(steps):
                columns[axis].take(at, out=off, mode="clip")
                np.add(off, moved[axis][k], out=off)
                if self.distance != "manhattan":
                    np.multiply(off, off, out=part)
                    d += part
                if self.distance != "euclidean":
                    np.abs(off, out=off)
                    d += off
            if which:
                np.putmask(best, d < nearest[0], n)
            for i in range(depth, 0, -1):
                np.minimum(nearest[i], d, out=part)
                np.maximum(part, nearest[i - 1], out=nearest[i])
            np.minimum(nearest[0], d, out=nearest[0])
        if which:
            winner = centre + np.moveaxis(np.array(cells)[best], -1, 0)
            if self.returns == "cell_value":
                return lattice_hash(self.seed, winner)
            return self.lookup.at(winner + np.stack([c[self._sum(0, winner)] for c in columns]))
        a, b = nearest[min(i0, depth)], nearest[depth]
        made = {"distance": lambda: nearest[0], "distance2": lambda: b, "distance2_add": lambda: b + a, "distance2_sub": lambda: b - a, "distance2_mul": lambda: b * a, "distance2_div": lambda: a / b}
        return made[self.returns]()
