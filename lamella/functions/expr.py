"""The masked, premultiply-aware evaluation rule that all per-sample operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.image import RGB, DeepImage

#: Channels that no per-sample operator changes.
UNTOUCHED = ("alpha", "z", "front", "back")
#: Before the name of a channel: its column that isn't multiplied by alpha yet, and that an operator works on.
STRAIGHT, VALUE = "_straight_", "_value_"


def guarded(value: Column, alpha: Column) -> Column:
    """``value / alpha``, and 0 where alpha is 0."""
    return F.when(alpha != 0, value / alpha).otherwise(F.lit(0.0))


def power(value: Column, exponent: float) -> Column:
    """``value ** exponent`` by the C library, as other engines have it: the JVM's last bit may be another one."""

    @F.arrow_udf("double")
    def raised(base: pa.Array) -> pa.Array:
        return pc.power(base, pa.scalar(exponent, pa.float64()))

    return raised(value)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def straight(image: DeepImage, channel: str, alpha: Column) -> Column:
    """A channel divided by alpha: what was multiplied by it, where the operator before did so."""
    if image.straight is not None and STRAIGHT + channel in image.straight.columns:
        return F.when(alpha != 0, F.col(STRAIGHT + channel)).otherwise(F.lit(0.0))
    return guarded(image.channel(channel), alpha)


def alpha_of(image: DeepImage, unpremult: bool, unpremult_deep_mask: bool) -> Column:
    return image.channel("alpha") if "alpha" in image.df.columns and (unpremult or unpremult_deep_mask) else F.lit(1.0)


def joined_mask(image: DeepImage, side_mask: DataFrame, channel: str) -> DataFrame:
    """The samples with their pixel's side-mask value in ``_side``; pixels that the mask doesn't have read 0.

    A flat image has one value for a pixel; where the table has several, the greatest counts, so samples never multiply. The
    aggregation shuffles by pixel, as the join does."""
    flat = side_mask.groupBy("x", "y").agg(F.max(F.col(channel)).alias("_side"))
    return (image.straight or image.df).join(flat, ["x", "y"], "left").withColumn("_side", F.coalesce("_side", F.lit(0.0)))


def masked(
    image: DeepImage,
    f: Callable[[str, Column, Column], Column],
    channels: Sequence[str] = RGB,
    unpremult: bool = True,
    deep_mask: str | None = None,
    invert_deep_mask: bool = False,
    unpremult_deep_mask: bool = True,
    side_mask: DataFrame | None = None,
    side_channel: str = "value",
    invert_mask: bool = False,
    mix: float = 1.0,
) -> DeepImage:
    """``image`` with each of ``channels`` replaced by ``f(channel, value, alpha)`` under the masks and ``mix``.

    The value is divided by alpha first and multiplied again after, if ``unpremult``; a chain of operators divides once. All
    channels change in one projection; a side mask adds one join by pixel."""
    mix = min(max(mix, 0.0), 1.0)
    process = [c for c in channels if c in image.df.columns and c not in UNTOUCHED]
    if mix == 0 or not process:
        return image
    df, alpha = image.straight or image.df, alpha_of(image, unpremult, unpremult_deep_mask)
    weight, skip = F.lit(mix), None
    if side_mask is not None:
        df = joined_mask(image, side_mask, side_channel)
        sm = clamp(F.col("_side"))
        sm = 1 - sm if invert_mask else sm
        weight, skip = weight * sm, sm == 0
    if deep_mask is not None:
        dm = F.lit(0.0)
        if deep_mask in image.df.columns:
            dm = guarded(F.col(deep_mask), alpha) if unpremult_deep_mask else F.col(deep_mask)
            dm = 1 - dm if invert_deep_mask else dm
        weight = weight * dm
        skip = dm == 0 if skip is None else skip | (dm == 0)
    plain = side_mask is None and deep_mask is None and mix == 1
    out, kept = {}, {}
    if unpremult:  # columns, so that an f that uses them more than once doesn't divide again
        df = df.withColumns({VALUE + c: straight(image, c, alpha) for c in process})
    for c in process:
        x = F.col(c)
        v = F.col(VALUE + c) if unpremult else x
        o = f(c, v, alpha)
        o = o if plain else o * weight + v * (1 - weight)
        if unpremult and skip is None and "alpha" in image.df.columns:
            kept[STRAIGHT + c] = o
        o = o * alpha if unpremult else o
        out[c] = o if skip is None else F.when(skip, x).otherwise(o)
    if kept:
        # what is multiplied is a column by then, so that it is worked out once
        before = [c for c in df.columns if c.startswith(STRAIGHT) and c not in kept]
        made = df.withColumns(kept).withColumns({c: F.col(STRAIGHT + c) * alpha for c in process}).select(*image.df.columns, *before, *kept)
        return image.but(df=made.select(*image.df.columns), straight=made)
    return image.with_df(df.withColumns(out).select(*image.df.columns))


def index_in_layer(channel: str) -> int:
    """A channel's place in its layer: red, green, blue, alpha; x, y, z, w; else 0."""
    last = channel.rsplit("_", 1)[-1]
    for names in (("red", "green", "blue", "alpha"), ("r", "g", "b", "a"), ("x", "y", "z", "w"), ("u", "v")):
        if last in names:
            return names.index(last)
    return 0


def siblings(image: DeepImage, channel: str) -> list[str]:
    """The first three channels of the layer that ``channel`` is in."""
    if channel in ("red", "green", "blue", "alpha"):
        return list(RGB)
    layer = channel.rsplit("_", 1)[0]
    for names in (("red", "green", "blue"), ("r", "g", "b"), ("x", "y", "z")):
        made = [f"{layer}_{n}" for n in names]
        if channel in made:
            return made
    return [channel]
