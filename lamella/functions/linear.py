"""Small matrices, worked out on the driver and unrolled into column arithmetic."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The RGB to YIQ matrix (fixed values).
YIQ = np.array([[0.299, 0.587, 0.114], [0.596, -0.274, -0.321], [0.211, -0.523, 0.311]])


def hue_matrix(hue: float, saturation: float, value: float) -> np.ndarray:
    u, w = math.cos(math.radians(hue)), math.sin(math.radians(hue))
    vs = value * saturation
    turned = np.array([[value, 0, 0], [0, vs * u, -vs * w], [0, vs * w, vs * u]])
    return np.linalg.inv(YIQ) @ turned @ YIQ


def fold(values: Sequence[Column], row: Sequence[float]) -> Column:
    """The sum of values times numbers."""
    out = F.lit(0.0)
    for v, m in zip(values, row, strict=False):
        out = out + v * float(m)
    return out


def projected(point: Sequence[Column], matrix: np.ndarray) -> list[Column]:
    """A 4 x 4 matrix applied to (x, y, z, 1), divided by w where w isn't 1 anyway."""
    homogeneous = [*point, F.lit(1.0)]
    x, y, z = (fold(homogeneous, matrix[i]) for i in range(3))
    if np.allclose(matrix[3], (0, 0, 0, 1)):
        return [x, y, z]
    w = fold(homogeneous, matrix[3])
    return [F.when(w != 0, v / w).otherwise(F.lit(0.0)) for v in (x, y, z)]


def rotate_z(degrees: float) -> np.ndarray:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    out = np.eye(4)
    out[:2, :2] = [[c, -s], [s, c]]
    return out


def scale(x: float, y: float) -> np.ndarray:
    return np.diag([x, y, 1.0, 1.0])


def translate(x: float, y: float) -> np.ndarray:
    out = np.eye(4)
    out[:2, 3] = [x, y]
    return out
