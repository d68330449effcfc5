"""The deep image: a DataFrame with one row per sample, and the little that is known of it before any row is read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXEL = ("x", "y")
#: Columns that place a sample; all others are channels.
PLACE = ("x", "y", "s", "front", "back")
#: Samples of a pixel in depth order; ``s`` (source order) makes it total.
DEPTH_ORDER = ("front", "back", "s")
RGB = ("red", "green", "blue")
RGBA = (*RGB, "alpha")

Box = tuple[int, int, int, int]
#: Columns that a tiled image is partitioned by, and the folders beside its data.
TILE, IMAGE, MANIFEST = ("tile_x", "tile_y"), "_image", "_manifest"


class Known:
    """A field that may be given as a function; it is called when the value is first asked for, and not again."""

    def __set_name__(self, owner, name):
        self.name = name

    def __get__(self, held, owner=None):
        if held is None:
            raise AttributeError(self.name)
        value = held.__dict__[self.name]
        if callable(value):
            value = held.__dict__[self.name] = value()
        return value

    def __set__(self, held, value):
        held.__dict__[self.name] = value


@dataclass(frozen=True)
class DeepImage:
    """Samples (x, y, s, front, back and channels as doubles), the half-open box they lie in, and the format.

    Box and format may be functions, for images whose size takes a job to find out. Missing channels read as 0, except alpha,
    which reads as 1. A pixel without samples has no row. ``recipe`` makes the part of the image inside a box from no more of
    its inputs than that part needs. ``straight`` is the table with columns more, the channels that a per-sample operator has just
    multiplied by alpha as they were before: the next one goes on from those, as a quotient of the product needn't be the same."""

    df: DataFrame
    bbox: Box = Known()
    format: tuple[int, int] = Known()
    recipe: Callable[[Box], DeepImage] | None = None
    straight: DataFrame | None = None

    @property
    def channels(self) -> list[str]:
        return [c for c in self.df.columns if c not in PLACE]

    def but(self, **changes) -> DeepImage:
        """The image with some fields changed. What isn't known yet stays so; another table has no recipe unless one is given."""
        made = object.__new__(DeepImage)
        made.__dict__.update(self.__dict__ | {"recipe": None} | ({"straight": None} if "df" in changes else {}) | changes)
        return made

    def with_df(self, df: DataFrame) -> DeepImage:
        return self.but(df=df)

    def transform(self, fn: Callable[..., DeepImage], *args, **kwargs) -> DeepImage:
        return fn(self, *args, **kwargs)

    def channel(self, name: str | None):
        """The column of a channel; 0 if it is missing or None."""
        if name is None:
            return F.lit(0.0)
        return F.col(name) if name in self.df.columns else F.lit(1.0 if name == "alpha" else 0.0)

    def request(self, box: Box) -> DeepImage:
        """The image inside ``box``. The request goes up through the operators that made it, each of which widens the box by what it
        reaches, so the scan reads no more than that."""
        made = self.recipe(box) if self.recipe else self.but(df=inside(self.df, box))
        return made.but(bbox=box, recipe=made.recipe)

    def write(self, path: str, tile: int | None = None) -> None:
        """Write as Parquet; with ``tile``, partitioned by square tiles of so many pixels, a file each unless a tile is large, with a
        manifest of what x, y and depth each file holds."""
        if not tile:
            self.df.write.parquet(path)
            return
        spark = self.df.sparkSession
        tiles = [F.floor(F.col(c) / tile).cast("int").alias(t) for c, t in zip(PIXEL, TILE, strict=True)]
        # rebalanced: a tile is one partition, small ones share one, and a tile with very many samples is split
        self.df.select("*", *tiles).hint("rebalance", *TILE).write.partitionBy(*TILE).parquet(path)
        held = [F.min(c).alias(f"min_{c}") for c in ("x", "y", "front", "back")] + [F.max(c).alias(f"max_{c}") for c in ("x", "y", "front", "back")]
        spark.read.parquet(path).groupBy(*TILE, F.input_file_name().alias("file")).agg(F.count("*").alias("samples"), *held).write.parquet(f"{path}/{MANIFEST}")
        facts = [F.lit(tile).alias("tile"), F.array(*map(F.lit, self.bbox)).alias("bbox"), F.array(*map(F.lit, self.format)).alias("format")]
        spark.range(1).select(*facts).coalesce(1).write.parquet(f"{path}/{IMAGE}")  # last: an image without it isn't whole


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file of a tiled image: its tile, its number of samples, and the least and greatest x, y, front and back."""
    return spark.read.parquet(f"{path}/{MANIFEST}")


def read(spark: SparkSession, path: str, bbox: Box | None = None, format: tuple[int, int] | None = None, depth: tuple[float, float] | None = None) -> DeepImage:
    """A written deep image, restricted to ``bbox`` and to samples that meet the interval ``depth``.

    Both reach the scan as pushed filters. Of a tiled image only the tiles that the box meets are listed, and of those only the ones
    whose depths meet the interval are read. An image without tiles needs a box."""
    try:
        facts = spark.read.parquet(f"{path}/{IMAGE}").head()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        facts = None
    if facts is None and bbox is None:
        raise ValueError("an image without tiles is read with a box")
    box = tuple(facts["bbox"]) if bbox is None else bbox
    rows = inside(spark.read.parquet(path), box)
    if facts is not None:
        for c, low, high in ((TILE[0], box[0], box[2]), (TILE[1], box[1], box[3])):
            rows = rows.where(F.col(c).between(low // facts["tile"], (high - 1) // facts["tile"]))
    if depth is not None:
        rows = rows.where((F.col("back") >= depth[0]) & (F.col("front") <= depth[1]))
        if facts is not None:
            met = manifest(spark, path).where((F.col("max_back") >= depth[0]) & (F.col("min_front") <= depth[1])).select(*TILE)
            rows = rows.join(met, list(TILE), "left_semi")  # pruned when the query runs
    size = format or (tuple(facts["format"]) if facts is not None else (box[2] - box[0], box[3] - box[1]))
    return DeepImage(rows.drop(*TILE), box, size, lambda part: read(spark, path, common(box, part), size, depth))


def inside(df: DataFrame, box: Box) -> DataFrame:
    x0, y0, x1, y1 = box
    return df.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def grown(box: Box, w: int, h: int) -> Box:
    return box[0] - w, box[1] - h, box[2] + w, box[3] + h


def union(a: Box, b: Box) -> Box:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def common(a: Box, b: Box) -> Box:
    """Where both boxes are; it may be empty."""
    return max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])


def per_pixel(operator: Callable[..., DeepImage]) -> Callable[..., DeepImage]:
    """For operators of which a pixel needs only that pixel of all their images: a box asked of the result is asked of those."""

    @wraps(operator)
    def made(image: DeepImage, *args, **kwargs) -> DeepImage:
        out = operator(image, *args, **kwargs)

        def part(box: Box) -> DeepImage:
            asked = lambda v: v.request(box) if isinstance(v, DeepImage) else v
            return made(asked(image), *map(asked, args), **{k: asked(v) for k, v in kwargs.items()})

        return out if out is image else out.but(recipe=part)

    return made
