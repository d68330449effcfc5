"""Keyed mixing of two images by a flat mask."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clamp, joined_mask
from ..sources.image import PIXEL, PLACE, DeepImage, union, per_pixel
from .channels import add_channels


@per_pixel
def keymix(b: DeepImage, a: DeepImage | None, mask: DataFrame | None, channels: Sequence[str] | None = None, mask_channel: str = "value", invert_mask: bool = False, mix: float = 1.0, bbox: str = "union") -> DeepImage:
    """Samples of B where the mask is 0, of A where it is 1 or more, between them those of both, weighted, B first.

    Missing A or mask, or no channels: B as it is. Both sides are joined with the mask by pixel at once and filtered: a pixel
    that needs one side only keeps no sample of the other. s numbers a pixel's samples anew, A's after B's."""
    mix = min(max(mix, 0.0), 1.0)
    if a is None or mask is None or channels is not None and not channels:
        return b
    names = [c for c in dict.fromkeys([*b.channels, *a.channels]) if channels is None or c in channels]
    a, b = add_channels(a, names), add_channels(b, names)
    key = clamp(F.col("_side"))
    key = (1 - key if invert_mask else key) * mix
    place = [c for c in PLACE if c in b.df.columns and c in a.df.columns]
    sides = [image.df.select(*place, *names, F.lit(first).alias("_first")) for image, first in ((b, True), (a, False))]
    both = joined_mask(b.with_df(sides[0].unionByName(sides[1])), mask, mask_channel).withColumn("_k", key)
    both = both.where(F.when(F.col("_first"), F.col("_k") < 1).otherwise(F.col("_k") > 0))
    weight = F.when(F.col("_first"), F.when(F.col("_k") <= 0, 1.0).otherwise(1 - F.col("_k"))).otherwise(F.when(F.col("_k") >= 1, 1.0).otherwise(F.col("_k")))
    number = [F.row_number().over(Window.partitionBy(*PIXEL).orderBy(F.desc("_first"), "s")).alias("_s")] if "s" in place else []
    both = both.select("*", *number)
    both = both.select(*[(F.col("_s") - 1).alias(c) if c == "s" else F.col(c) for c in place], *[(F.col(c) * weight).alias(c) for c in names])
    box = {"union": lambda: union(a.bbox, b.bbox), "A": lambda: a.bbox, "B": lambda: b.bbox}[bbox]
    return b.but(df=both, bbox=box)
