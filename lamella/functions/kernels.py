"""Weights that are worked out once, on the driver."""

from __future__ import annotations

import math


def radius(size: float) -> int:
    return math.ceil(size)


def half_kernel(size: float, quality: str = "medium") -> list[float]:
    """Weights at 0, 1, ... of a Gaussian with deviation ``max(size / 3, .001)``: its density (low), normalised over the whole
    window (medium), or its mass in equal bins over seven deviations, normalised (high)."""
    r, sigma = radius(size), max(size / 3, 0.001)
    if r == 0:
        return [1.0]
    if quality == "high":
        cdf = lambda z: (1 + math.erf(z / math.sqrt(2))) / 2
        width = 7 / (2 * r + 1)
        made = [cdf((i + 0.5) * width) - cdf((i - 0.5) * width) for i in range(r + 1)]
    else:
        made = [math.exp(-(i * i) / (2 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi)) for i in range(r + 1)]
    if quality == "low":
        return made
    total = made[0] + 2 * sum(made[1:])
    return [x / total for x in made]


def plane_kernel(width: float, height: float, quality: str = "medium") -> list[tuple[int, int, float]]:
    """(dx, dy, weight) of the product of two kernels, without weights of 0."""
    a, b = half_kernel(width, quality), half_kernel(height, quality)
    made = [(dx, dy, a[abs(dx)] * b[abs(dy)]) for dy in range(-len(b) + 1, len(b)) for dx in range(-len(a) + 1, len(a))]
    return [k for k in made if k[2] > 0]


def depth_weights(n: int, falloff: str = "linear") -> list[float]:
    """Weights of ``n`` points from -1 to 1, with sum 1; even ones if the shape gives none any."""
    if n <= 1:
        return [1.0]
    shape = {
        "linear": lambda t: 1 - abs(t),
        "gaussian": lambda t: math.exp(-0.5 * (3 * t) ** 2),
        "smoothstep": lambda t: 3 * (1 - abs(t)) ** 2 - 2 * (1 - abs(t)) ** 3,
        "exponential": lambda t: math.exp(-3 * abs(t)),
    }[falloff]
    made = [shape(2 * i / (n - 1) - 1) for i in range(n)]
    total = sum(made)
    return [x / total for x in made] if total > 0 else [1 / n] * n
