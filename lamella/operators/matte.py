"""Mattes: a value for each sample, combined into output channels under the masked rule."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clamp, guarded, masked
from ..functions.linear import projected, rotate_z, scale, translate
from ..functions.noise import Noise
from ..sources.image import RGB, DeepImage, per_pixel
from .channels import add_channels
from .color import grade_numbers, graded
from .ordered import depth_order

OPERATIONS = ("replace", "union", "mask", "stencil", "out", "min", "max")


def combined(v: Column, p: Column, operation: str) -> Column:
    """A channel's value ``v`` and the matte ``p``."""
    made = {
        "replace": lambda: p,
        "union": lambda: v + p - v * p,
        "mask": lambda: v * p,
        "stencil": lambda: v * (1 - p),
        "out": lambda: (1 - v) * p,
        "min": lambda: F.least(v, p),
        "max": lambda: F.greatest(v, p),
    }
    return made[operation]()


def _apply(image: DeepImage, matte: Column, output: Sequence[str], operation: str, **rule) -> DeepImage:
    image = add_channels(image, output)
    held = image.with_df(image.df.withColumn("_matte", matte))
    out = masked(held, lambda c, v, a: combined(v, F.col("_matte"), operation), channels=output, **rule)
    return out.with_df(out.df.drop("_matte"))


def id_value(image: DeepImage, id_channel: str | None, unpremult_id: bool) -> Column:
    value = image.channel(id_channel)
    return guarded(value, image.channel("alpha")) if unpremult_id else value


@per_pixel
def id_matte(image: DeepImage, id_channel: str | None, id: float | Column = 0.0, tolerance: float = 0.5, unpremult_id: bool = True, output: Sequence[str] = RGB, operation: str = "replace", **rule) -> DeepImage:
    """1 where the sample's id is less than ``tolerance`` from ``id``, else 0. ``id`` may be ``picked_id``; of an empty pixel no sample has it."""
    wanted = id if isinstance(id, Column) else float(id)
    matte = F.when(F.abs(id_value(image, id_channel, unpremult_id) - wanted) < float(tolerance), 1.0).otherwise(0.0)
    return _apply(image, matte, output, operation, **rule)


def position(image: DeepImage, channels: Sequence[str], unpremult: bool) -> list[Column]:
    raw = [image.channel(c) for c in channels]
    return [guarded(v, image.channel("alpha")) for v in raw] if unpremult else raw


def smoothstep(t: Column) -> Column:
    t = clamp(t)
    return t * t * (3 - 2 * t)


@per_pixel
def position_matte(
    image: DeepImage,
    position_data: Sequence[str],
    selection=None,
    shape: str = "sphere",
    falloff_type: str = "smooth",
    falloff: float = 1.0,
    falloff_gamma: float = 1.0,
    unpremult_position: bool = True,
    output: Sequence[str] = RGB,
    operation: str = "replace",
    centre: Column | None = None,
    **rule,
) -> DeepImage:
    """Distance from the centre of a unit sphere or cube, placed by the 4 x 4 ``selection`` (inverted once, here). ``centre``
    (``picked_centre``) takes the place of the selection's translation, unless its pixel is empty."""
    place = np.asarray(np.eye(4) if selection is None else selection, float)
    found = position(image, position_data, unpremult_position)
    if centre is not None:
        found = [v - F.coalesce(centre[f"c{i}"], F.lit(float(place[i, 3]))) for i, v in enumerate(found)]
        place = place.copy()
        place[:3, 3] = 0
    p = projected(found, np.linalg.inv(place))
    if shape == "sphere":
        d = F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])
    elif shape == "cube":
        d = 1 - clamp(1 - F.abs(p[0])) * clamp(1 - F.abs(p[1])) * clamp(1 - F.abs(p[2]))
    else:
        raise ValueError(f"shape {shape}")
    d = clamp((1 - d) / float(falloff)) if falloff else F.when(d < 1, 1.0).otherwise(0.0)
    d = d if falloff_gamma == 1 else F.pow(d, F.lit(1 / float(falloff_gamma)))
    return _apply(image, smoothstep(d) if falloff_type == "smooth" else clamp(d), output, operation, **rule)


@per_pixel
def noise_matte(
    image: DeepImage,
    position_data: Sequence[str],
    noise: Noise | None = None,
    noise_evolution: float = 0.0,
    selection=None,
    unpremult_position: bool = True,
    output: Sequence[str] = RGB,
    operation: str = "replace",
    reverse: bool = False,
    black_clamp: bool = False,
    white_clamp: bool = False,
    grade: dict[str, float] | None = None,
    **rule,
) -> DeepImage:
    """Four-dimensional noise at the sample's position, brought to 0..1 and graded. The noise is an Arrow function over numpy
    arrays; all around it stays in the JVM."""
    given = {"blackpoint": 0.0, "whitepoint": 1.0, "black": 0.0, "white": 1.0, "multiply": 1.0, "add": 0.0, "gamma": 1.0} | (grade or {})
    inverse = np.linalg.inv(np.asarray(np.eye(4) if selection is None else selection, float))
    p = projected(position(image, position_data, unpremult_position), inverse)
    n = (noise or Noise()).column(*p, F.lit(float(noise_evolution))) * 0.5 + 0.5
    held = image.with_df(image.df.withColumn("_noise", n))
    matte = graded(F.col("_noise"), grade_numbers(**given, reverse=reverse), reverse, black_clamp, white_clamp)
    out = _apply(held, matte, output, operation, **rule)
    return out.with_df(out.df.drop("_noise"))


@dataclass(frozen=True)
class Camera:
    """A camera's world matrix and lens."""

    matrix: Sequence[Sequence[float]] = field(default_factory=lambda: np.eye(4).tolist())
    haperture: float = 24.576
    vaperture: float = 18.672
    focal: float = 50.0
    win_roll: float = 0.0
    win_scale: tuple[float, float] = (1.0, 1.0)
    win_translate: tuple[float, float] = (0.0, 0.0)

    def to_world(self) -> np.ndarray:
        window = rotate_z(self.win_roll) @ scale(1 / self.win_scale[0], 1 / self.win_scale[1]) @ translate(-self.win_translate[0], -self.win_translate[1])
        return np.asarray(self.matrix, float) @ np.linalg.inv(window)


@per_pixel
def world_position(image: DeepImage, camera: Camera | None = None, output: Sequence[str] = ("world_x", "world_y", "world_z"), depth_sample: str = "front", premultiplied_output: bool = True, pixel_centre: float = 0.5) -> DeepImage:
    """World coordinates of each sample from its pixel and depth; a fourth output channel is 0."""
    camera = camera or Camera()
    w, h = image.format
    depth = {"front": F.col("front"), "back": F.col("back"), "average": (F.col("front") + F.col("back")) / 2}[depth_sample]
    ndc = [(F.col("x") + pixel_centre) / float(w) * 2 - 1, (F.col("y") + pixel_centre) / float(h) * 2 - 1]
    point = [ndc[0] * (camera.haperture / 2 / camera.focal) * depth, ndc[1] * (camera.vaperture / 2 / camera.focal) * depth, -depth]
    made = projected(point, camera.to_world())
    alpha = image.channel("alpha")
    values = [v * alpha if premultiplied_output else v for v in made] + [F.lit(0.0)]
    return image.with_df(image.df.withColumns(dict(zip(output, values, strict=False))))


def picked(image: DeepImage, x: int, y: int, channels: Sequence[str], sample: str = "closest", unpremult: bool = True) -> DataFrame:
    """One row: the values of the closest or furthest sample of one pixel, nulls if the pixel is empty. The scan's filters narrow it down."""
    alpha = image.channel("alpha")
    values = [(guarded(image.channel(c), alpha) if unpremult else image.channel(c)).alias(c) for c in channels]
    key = F.struct(*depth_order(image.df))
    best = (F.min_by if sample == "closest" else F.max_by)(F.struct(*values), key)
    return image.request((x, y, x + 1, y + 1)).df.agg(best.alias("p")).select("p.*")


def pick(image: DeepImage, x: int, y: int, channels: Sequence[str], sample: str = "closest", unpremult: bool = True) -> list[float] | None:
    """What ``picked`` has, on the driver; None if the pixel is empty."""
    row = list(picked(image, x, y, channels, sample, unpremult).head())
    return None if all(v is None for v in row) else row


def picked_id(image: DeepImage, x: int, y: int, id_channel: str, sample: str = "closest", unpremult: bool = True) -> Column:
    """The id of a picked sample, as a parameter of ``id_matte``: a subquery of the query that uses it."""
    return picked(image, x, y, [id_channel], sample, unpremult).scalar()


def picked_centre(image: DeepImage, x: int, y: int, position_data: Sequence[str], sample: str = "closest", unpremult: bool = True) -> Column:
    """The position of a picked sample, as a parameter of ``position_matte``."""
    found = picked(image, x, y, position_data, sample, unpremult)
    return found.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(position_data)])).scalar()


@per_pixel
def picks(image: DeepImage, channels: Sequence[str], sample: str = "closest") -> DeepImage:
    """Every pixel's closest or furthest sample, for picking many at a time: one aggregation without a sort."""
    key = F.struct("front", "back", "s") if "s" in image.df.columns else F.struct("front", "back")
    best = (F.min_by if sample == "closest" else F.max_by)(F.struct(*[image.channel(c).alias(c) for c in channels]), key)
    return image.with_df(image.df.groupBy("x", "y").agg(best.alias("p")).select("x", "y", "p.*"))
