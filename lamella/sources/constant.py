"""A generated deep image: every pixel of the format gets the same ``samples`` slices of depth."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .image import RGBA, DeepImage


def alpha_scaled(value: float, alpha: float, n: int, mode: str) -> float:
    """What one of ``n`` samples has of ``value``, so that all together make it up as ``mode`` says."""
    if mode == "uniform":
        return value
    if mode == "additive":
        return value / n
    if mode == "multiplicative":
        return 0.0 if alpha == 0 else value / alpha * (1 - (1 - alpha) ** (1 / n))
    raise ValueError(f"alpha mode {mode}")


def constant(spark: SparkSession, format: tuple[int, int], channels=RGBA, color_front=(0.2,) * 4, color_back=(0.5,) * 4, front: float = 0.0, back: float = 10.0, samples: int = 1, alpha_mode: str = "multiplicative") -> DeepImage:
    """Samples from ``front`` to ``back``; colours go from ``color_front`` towards ``color_back`` (reached at the n-th step, which no
    sample starts at). An alpha of 0 or less, once scaled, becomes 1e-6 at either end."""
    n, (w, h) = max(samples, 1), format
    alphas = [dict(zip(channels, c, strict=False)).get("alpha", 1.0) for c in (color_front, color_back)]
    ends = [[alpha_scaled(v, a, n, alpha_mode) for v in c] for c, a in zip((color_front, color_back), alphas, strict=True)]
    ends = [[1e-6 if c == "alpha" and v <= 0 else v for c, v in zip(channels, end, strict=False)] for end in ends]
    step = (back - front) / n
    slices = []
    for i in range(n):
        t = i * step / (back - front) if back != front else 0.0
        made = {c: t * b + (1 - t) * a for c, a, b in zip(channels, *ends, strict=False)}
        slices.append(F.struct(F.lit(i).alias("s"), F.lit(front + i * step).alias("front"), F.lit(front + (i + 1) * step).alias("back"), *[F.lit(float(v)).alias(c) for c, v in made.items()]))
    pixels = spark.range(w * h).select((F.col("id") % w).cast("int").alias("x"), F.floor(F.col("id") / w).cast("int").alias("y"))
    return DeepImage(pixels.select("x", "y", F.inline(F.array(*slices))), (0, 0, w, h), format)
