"""Colour operators: per-sample expressions under the masked rule. Keyword arguments beyond the named go to ``masked``."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import alpha_of, clamp, index_in_layer, masked, power, siblings, straight
from ..functions.linear import fold, hue_matrix
from ..sources.image import DeepImage, per_pixel

Triple = Sequence[float]
#: Luminance weights. Rec. 709 and CCIR 601 are published constants.
LUMINANCE = {"rec709": (0.2126, 0.7152, 0.0722), "ccir601": (0.299, 0.587, 0.114), "average": (1 / 3, 1 / 3, 1 / 3)}
GAMMA_RANGE = (1e-5, 65500.0)


def _of(values: Triple, c: str) -> float | None:
    """The parameter for a channel; None for a layer's fourth, which passes through."""
    i = index_in_layer(c)
    return values[i] if i < 3 else None


@per_pixel
def add(image: DeepImage, value: Triple = (0, 0, 0), **rule) -> DeepImage:
    return masked(image, lambda c, v, a: v if _of(value, c) is None else v + float(_of(value, c)), **rule)


@per_pixel
def multiply(image: DeepImage, value: Triple = (1, 1, 1), **rule) -> DeepImage:
    return masked(image, lambda c, v, a: v if _of(value, c) is None else v * float(_of(value, c)), **rule)


@per_pixel
def gain(image: DeepImage, value: float = 1.0, **rule) -> DeepImage:
    return masked(image, lambda c, v, a: v * float(value), **rule)


@per_pixel
def gamma(image: DeepImage, value: Triple = (1, 1, 1), **rule) -> DeepImage:
    def f(c: str, v: Column, a: Column) -> Column:
        g = _of(value, c)
        return v if g is None or g == 1 else power(v, 1 / min(max(g, GAMMA_RANGE[0]), GAMMA_RANGE[1]))

    return masked(image, f, **rule)


@per_pixel
def invert(image: DeepImage, clamped: bool = False, **rule) -> DeepImage:
    return masked(image, lambda c, v, a: clamp(1 - v) if clamped else 1 - v, **rule)


@per_pixel
def clamp_channels(
    image: DeepImage,
    minimum: Triple = (0, 0, 0),
    maximum: Triple = (1, 1, 1),
    minimum_enable: bool = True,
    maximum_enable: bool = True,
    min_clamp_to: Triple = (0, 0, 0),
    max_clamp_to: Triple = (1, 1, 1),
    min_clamp_to_enable: bool = False,
    max_clamp_to_enable: bool = False,
    **rule,
) -> DeepImage:
    """Both bounds are tested on the value as it came; where both hit, the upper wins."""

    def f(c: str, v: Column, a: Column) -> Column:
        if _of(minimum, c) is None:
            return v
        out = v
        if minimum_enable:
            out = F.when(v < float(_of(minimum, c)), float(_of(min_clamp_to if min_clamp_to_enable else minimum, c))).otherwise(out)
        if maximum_enable:
            out = F.when(v > float(_of(maximum, c)), float(_of(max_clamp_to if max_clamp_to_enable else maximum, c))).otherwise(out)
        return out

    return masked(image, f, **rule)


@per_pixel
def posterize(image: DeepImage, colors: float = 10, **rule) -> DeepImage:
    """``colors`` steps, rounded towards zero."""
    n = float(max(colors, 1))
    return masked(image, lambda c, v, a: F.signum(v) * F.floor(F.abs(v) * n) / n, **rule)


def grade_numbers(blackpoint: float, whitepoint: float, black: float, white: float, multiply: float, add: float, gamma: float, reverse: bool) -> tuple[float, float, float]:
    """A, B and G of a grade: ``(A v + B) ** G``, or ``A v ** G + B`` if ``reverse``."""
    a = multiply * (white - black) / (whitepoint - blackpoint) if whitepoint != blackpoint else math.inf
    b = add + black - a * blackpoint
    g = 1 / min(max(gamma, GAMMA_RANGE[0]), GAMMA_RANGE[1])
    if reverse:
        a = 1 / a if a else 1.0
        return a, -b * a, 1 / g
    return a, b, g


def graded(v: Column, numbers: tuple[float, float, float], reverse: bool, black_clamp: bool, white_clamp: bool) -> Column:
    a, b, g = numbers
    raised = lambda x: x if g == 1 else power(x, g)
    out = raised(v) * a + b if reverse else raised(v * a + b)
    out = F.greatest(out, F.lit(0.0)) if black_clamp else out
    return F.least(out, F.lit(1.0)) if white_clamp else out


GRADE = {"blackpoint": (0, 0, 0), "whitepoint": (1, 1, 1), "black": (0, 0, 0), "white": (1, 1, 1), "multiply": (1, 1, 1), "add": (0, 0, 0), "gamma": (1, 1, 1)}


@per_pixel
def grade(image: DeepImage, reverse: bool = False, black_clamp: bool = False, white_clamp: bool = False, **kwargs) -> DeepImage:
    """Parameters as in ``GRADE``, each a number or one for each channel of the layer; the coefficients are folded here."""
    given = {k: kwargs.pop(k, v) for k, v in GRADE.items()}
    given = {k: (v,) * 3 if isinstance(v, int | float) else v for k, v in given.items()}

    def f(c: str, v: Column, a: Column) -> Column:
        if _of(given["gamma"], c) is None:
            return v
        return graded(v, grade_numbers(**{k: float(_of(x, c)) for k, x in given.items()}, reverse=reverse), reverse, black_clamp, white_clamp)

    return masked(image, f, **kwargs)


def _layer(image: DeepImage, c: str, alpha: Column) -> list[Column]:
    return [straight(image, s, alpha) for s in siblings(image, c)]


@per_pixel
def saturation(image: DeepImage, saturation: float = 1.0, mode: str = "rec709", weights: Triple | None = None, **rule) -> DeepImage:
    """Mix with the luminance of the layer; its channels are divided by alpha whether or not the rule does so."""

    def f(c: str, v: Column, a: Column) -> Column:
        if index_in_layer(c) > 2:
            return v
        layer = _layer(image, c, a)
        lum = F.greatest(*layer) if mode == "maximum" else sum((x * w for x, w in zip(layer, weights or LUMINANCE[mode], strict=False)), F.lit(0.0))
        return v * float(saturation) + lum * (1 - float(saturation))

    return masked(image, f, **rule)


def _linear(image: DeepImage, matrix: np.ndarray, **rule) -> DeepImage:
    def f(c: str, v: Column, a: Column) -> Column:
        i = index_in_layer(c)
        return v if i > 2 else fold(_layer(image, c, a), matrix[i])

    return masked(image, f, **rule)


@per_pixel
def hue_shift(image: DeepImage, hue: float = 0.0, saturation: float = 1.0, value: float = 1.0, **rule) -> DeepImage:
    """Hue rotation in YIQ, in degrees; the three matrices are one."""
    return _linear(image, hue_matrix(hue, saturation, value), **rule)


@per_pixel
def color_matrix(image: DeepImage, matrix: Sequence[Triple], invert: bool = False, **rule) -> DeepImage:
    m = np.asarray(matrix, float)
    return _linear(image, np.linalg.inv(m) if invert else m, **rule)


Curve = Sequence[tuple[float, float]]


def tangents(points: Curve) -> list[float]:
    """Slopes of a smooth curve at its points: that from the point before to the point after, at the ends that of the end segment."""
    n = len(points)
    exact = [(Fraction(repr(float(a))), Fraction(repr(float(b)))) for a, b in points]  # differences of the numbers as written
    return [float((exact[min(i + 1, n - 1)][1] - exact[max(i - 1, 0)][1]) / (exact[min(i + 1, n - 1)][0] - exact[max(i - 1, 0)][0])) for i in range(n)]


def curve(v: Column, points: Curve, smooth: bool = False) -> Column:
    """A curve through points (source, target): straight segments, or cubic ones whose slopes agree where they meet (``smooth``).

    Beyond the ends it goes on straight. No points: identity."""
    points = sorted((float(a), float(b)) for a, b in points)
    if not points:
        return v
    if len(points) == 1:
        return v + (points[0][1] - points[0][0])
    slopes = tangents(points)
    out = None
    for i in reversed(range(len(points) - 1)):
        (x0, y0), (x1, y1) = points[i], points[i + 1]
        width = x1 - x0
        if smooth:
            t = (v - x0) / width
            rise, bend = slopes[i] * width, slopes[i + 1] * width
            square, cube = 2.0 * t * t, 2.0 * t * t * t
            piece = (cube - 3.0 * t * t + 1.0) * y0 + (t * t * t - square + t) * rise + (3.0 * t * t - cube) * y1 + (t * t * t - t * t) * bend
            if i == len(points) - 2:
                piece = F.when(v > x1, (v - x1) * slopes[-1] + y1).otherwise(piece)
            if i == 0:
                piece = F.when(v < x0, (v - x0) * slopes[0] + y0).otherwise(piece)
        else:
            piece = (v - x0) * ((y1 - y0) / width) + y0
        out = piece if out is None else F.when(v < x1, piece).otherwise(out)
    return out


@per_pixel
def color_lookup(image: DeepImage, master: Curve = (), red: Curve = (), green: Curve = (), blue: Curve = (), smooth: bool = False, **rule) -> DeepImage:
    """Each channel's own curve of the master curve's value."""
    own = (red, green, blue)
    return masked(image, lambda c, v, a: curve(curve(v, master, smooth), own[index_in_layer(c)] if index_in_layer(c) < 3 else (), smooth), **rule)


def set_rgb(source: Triple, target: Triple) -> dict[str, Curve]:
    """Curves that take each channel of a source colour to the target's, through black and white otherwise."""
    return {c: tuple({0.0: 0.0, 1.0: 1.0, float(s): float(t)}.items()) for c, s, t in zip(("red", "green", "blue"), source, target, strict=True)}


@per_pixel
def map_channels(image: DeepImage, fn, **rule) -> DeepImage:
    """A user's own per-sample operator: ``fn(channel, value, alpha) -> Column`` under the masked rule."""
    return masked(image, fn, **rule)


def sample_alpha(image: DeepImage) -> Column:
    return alpha_of(image, True, True)
