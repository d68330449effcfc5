"""Depth blur: a sample becomes several along its depth that together look like it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import depth_weights
from ..sources.image import PLACE, DeepImage, per_pixel
from .ordered import with_alpha
from .tidy import powers
from .walk import Samples, walked

FAINT = 1e-6


@per_pixel
def depth_blur(image: DeepImage, spread: float = 1.0, num_samples: int = 5, falloff: str = "linear", sample_type: str = "volumetric", gate: DeepImage | None = None, empty_gate: str = "spread") -> DeepImage:
    """Spread each sample over ``spread`` around its front, ``num_samples`` parts with weights of the ``falloff``.

    A part's alpha is ``1 - (1 - a) ** w``; parts below 1e-6 aren't made. With a ``gate`` only samples that reach one of the
    gate's samples in their pixel are spread, and in pixels where the gate has none all (``empty_gate='spread'``) or none.
    Samples and gate are swept together by depth. Then overlaps are cut back. Parts are made in a walk over a pixel's sorted
    samples, so only the samples themselves are shuffled and sorted."""
    spread, n = max(spread, 0.0), max(num_samples, 1)
    if spread < 1e-6 or n <= 1:
        return image
    if "alpha" not in image.df.columns:
        return with_alpha(image, lambda full: depth_blur(full, spread, n, falloff, sample_type, gate, empty_gate))
    step, half = spread / n, step_half(spread, n)
    df = image.df
    spreads = F.col("alpha") >= FAINT
    if gate is not None:
        df = _touched(df, gate.df, spread / 2)
        spreads = spreads & F.when(F.col("_gated"), F.col("_touched")).otherwise(F.lit(empty_gate == "spread"))
    weights, flat = np.array(depth_weights(n, falloff)), sample_type == "flat"

    def spread_out(samples: Samples) -> dict[str, np.ndarray]:
        wide = np.flatnonzero(samples["_spreads"])
        alpha = samples.alpha[wide]
        parts = 1 - powers(np.repeat(1 - alpha, n), np.tile(weights, len(wide)))
        of, i = np.divmod(np.flatnonzero(parts >= FAINT), n)
        parts, of = parts[parts >= FAINT], wide[of]
        same = np.flatnonzero(~samples["_spreads"])
        source = np.concatenate((of, same))
        centre = samples["front"][of] - spread / 2 + half + i * step
        made = {c: v[source] for c, v in samples.columns.items()}
        share = np.concatenate((parts / samples.alpha[of], np.ones(len(same))))
        for c in samples.channels:
            if c != "_spreads":
                made[c] = made[c] * share
        made["front"][: len(of)], made["back"][: len(of)] = (centre, centre) if flat else (centre - half, centre + half)
        made["alpha"][: len(of)], made["s"] = parts, made["s"].astype(np.int64) * n
        made["s"][: len(of)] += i
        pixel = samples.pixel[source]
        order = np.lexsort((made["s"], made["back"], made["front"], pixel))
        made, pixel = {c: v[order] for c, v in made.items()}, pixel[order]
        follows = np.flatnonzero(pixel[1:] == pixel[:-1])
        made["back"][follows] = np.minimum(made["back"][follows], made["front"][follows + 1])
        return made

    rows = df.select(*image.df.columns, F.coalesce(spreads, F.lit(False)).alias("_spreads"))
    return image.with_df(walked(rows, spread_out).drop("_spreads"))


def _touched(df: DataFrame, gate: DataFrame, reach: float) -> DataFrame:
    """``df`` with _touched: whether a sample, made longer by ``reach`` on both sides, meets one of the gate's in its pixel; and
    _gated: whether the gate has any there.

    Of the gate's samples that begin before the longer sample ends, the one that ends last decides. So both sides are sorted by
    that depth, gate first, and the greatest back so far is carried along: one shuffle by pixel, no pairs."""
    rows = df.select("*", (F.col("back") + reach).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_end"))
    gates = gate.select("x", "y", F.col("front").cast("double").alias("_at"), F.lit(0).alias("_side"), F.col("back").cast("double").alias("_end"))
    both = rows.unionByName(gates, allowMissingColumns=True)
    swept = Window.partitionBy("x", "y").orderBy("_at", "_side")
    so_far = F.max("_end").over(swept.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ever = F.max("_end").over(swept.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = both.select("*", so_far.alias("_so_far"), ever.isNotNull().alias("_gated")).where("_side = 1")
    return marked.withColumn("_touched", F.coalesce(F.col("_so_far") >= F.col("front") - reach, F.lit(False))).drop("_at", "_side", "_end", "_so_far")


def step_half(spread: float, n: int) -> float:
    return spread / n / 2
