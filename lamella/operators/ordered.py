"""Depth-ordered operators: accumulation and flattening. A pixel's samples meet by one shuffle on (x, y)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.image import DEPTH_ORDER, PIXEL, DeepImage, per_pixel


def depth_order(df: DataFrame) -> list[str]:
    return [c for c in DEPTH_ORDER if c in df.columns]


def pixel_window(df: DataFrame, *more: str) -> WindowSpec:
    return Window.partitionBy(*PIXEL, *more).orderBy(*depth_order(df))


def transmitted(alpha: Column, window: WindowSpec) -> Column:
    """What the samples before let through: the product of 1 - alpha."""
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.product(1 - alpha).over(before), F.lit(1.0))


def with_transmitted(df: DataFrame, *more: str, name: str = "_t") -> DataFrame:
    return df.withColumn(name, transmitted(F.col("alpha"), pixel_window(df, *more)))


def composited(df: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """One row for each group of ``keys``: its samples laid over each other, front to back.

    Front is the least and back the greatest depth of the samples that are seen; what lies behind an opaque one adds nothing.
    The window and the aggregation share one shuffle by pixel."""
    more = [k for k in keys if k not in PIXEL]
    seen = F.col("_t") > 0
    rows = with_transmitted(df, *more)
    first = F.min("s").alias("s") if "s" in df.columns and "s" not in keys else None
    depth = [f for f in (F.min(F.when(seen, F.col("front"))).alias("front"), F.max(F.when(seen, F.col("back"))).alias("back")) if f is not None]
    depth = [d for d, n in zip(depth, ("front", "back"), strict=True) if n not in keys]
    return rows.groupBy(*keys).agg(*depth, *([first] if first is not None else []), *[F.sum(F.col(c) * F.col("_t")).alias(c) for c in channels])


def with_alpha(image: DeepImage, fn: Callable[[DeepImage], DeepImage]) -> DeepImage:
    """``fn`` over the image; where it has no alpha, over one with an alpha of 1, which goes again."""
    if "alpha" in image.df.columns:
        return fn(image)
    out = fn(image.with_df(image.df.withColumn("alpha", F.lit(1.0))))
    return out.with_df(out.df.drop("alpha"))


@per_pixel
def flatten(image: DeepImage, most: int | None = None) -> DeepImage:
    """One sample per pixel: the over-composite of all.

    With ``most``, a pixel of more samples than that isn't one task's: it is cut into ranges of depth of about so many, which are
    composited by themselves and then with each other, as *over* is associative. To find such pixels takes a job over x and y."""

    def flat(full: DeepImage) -> DeepImage:
        cuts = _cuts(full.df, most) if most else None
        out = composited(full.df, PIXEL, full.channels) if cuts is None else _merged(full, cuts)
        return full.with_df(out.select(*[c for c in full.df.columns if c in out.columns]))

    return with_alpha(image, flat)


#: Samples that are drawn for each range of a large pixel, to cut it by; pixels and cuts that are broadcast at most.
DRAWN, BROADCAST = 32, 200_000


def _cuts(df: DataFrame, most: int) -> DataFrame | None:
    """(x, y, _cuts): the places, in depth order, at which pixels of over ``most`` samples are cut. None if there is no such pixel.

    Only how many there are comes to the driver, which decides on a broadcast by it."""
    large = df.groupBy(*PIXEL).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    pixels, samples = large.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).head()
    if not pixels:
        return None
    hinted = F.broadcast if pixels + samples // most <= BROADCAST else lambda side: side
    place = F.struct(*depth_order(df))
    # a sample is drawn by the hash of its place, so that it is the same one when its task runs again
    drawn = df.join(hinted(large.select(*PIXEL)), list(PIXEL)).where(F.pmod(F.xxhash64(*PIXEL, *depth_order(df)), F.lit(1 << 20)) < min(1.0, DRAWN / most) * (1 << 20))
    ranked = drawn.groupBy(*PIXEL).agg(F.array_sort(F.collect_list(place)).alias("_drawn"))
    every = F.filter("_drawn", lambda p, i: (i + 1) % DRAWN == 0)
    return hinted(ranked.select(*PIXEL, F.array_distinct(every).alias("_cuts")))


def _merged(image: DeepImage, cuts: DataFrame) -> DataFrame:
    """The composite of every pixel, by way of its ranges: a range hides what lies behind it by the product of its 1 - alpha."""
    place = F.struct(*depth_order(image.df))
    ranged = image.df.join(cuts, list(PIXEL), "left")
    ranged = ranged.withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= place)), F.lit(0))).drop("_cuts")
    parts, channels = composited(ranged, [*PIXEL, "_range"], image.channels), image.channels
    window = Window.partitionBy(*PIXEL).orderBy("_range")
    # 1 - alpha of a range's composite is what the range lets through
    rows = parts.withColumn("_t", transmitted(F.col("alpha"), window))
    seen = F.col("_t") > 0
    first = [F.min("s").alias("s")] if "s" in parts.columns else []
    return rows.groupBy(*PIXEL).agg(F.min(F.when(seen, F.col("front"))).alias("front"), F.max(F.when(seen, F.col("back"))).alias("back"), *first, *[F.sum(F.col(c) * F.col("_t")).alias(c) for c in channels])


@per_pixel
def max_samples(image: DeepImage, k: int) -> DeepImage:
    """The ``k`` frontmost samples of each pixel; 0 keeps all."""
    if k <= 0:
        return image
    ranked = image.df.withColumn("_r", F.row_number().over(pixel_window(image.df)))
    return image.with_df(ranked.where(F.col("_r") <= k).drop("_r"))
