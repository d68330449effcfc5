"""Blurs across pixels: each sample is scattered to the pixels around it, where the samples that meet are optimised.

Samples are dealt to square tiles of pixels. A tile also gets those of the pixels within the kernel's reach, so what the shuffle
copies grows with the tiles' edges, and the kernel is applied after it, inside the tile, region by region. Where a pixel keeps no
more than so many merged samples, what it gets is made and tidied from the front on until there are so many. A box asked of the
result is widened by the reach before it gets to the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.kernels import plane_kernel, radius
from ..sources.image import PLACE, Box, DeepImage, common, grown, per_pixel
from .ordered import pixel_window
from .tidy import frontmost, unpremultiplied
from .walk import Samples, blocks, by_number, ids_of, starts_of, to_arrays, to_batch

#: Pixels a tile has on each side: so many at least, and so many times the kernel's reach.
SIDE, REACHES = 32, 8
#: Scattered samples that are worked on at a time, unless one pixel gets more.
SCATTERED = 400_000


class Kernel:
    """The entries of a kernel over the plane, as arrays."""

    def __init__(self, entries: list[tuple[int, int, float]]):
        self.dx, self.dy = (np.array([e[i] for e in entries], np.int64) for i in (0, 1))
        self.weight = np.array([e[2] for e in entries])
        self.rx, self.ry = int(np.abs(self.dx).max()), int(np.abs(self.dy).max())

    def __len__(self) -> int:
        return len(self.weight)

    def scattered(self, samples: Samples, box: Box) -> Scattered:
        """What the pixels of ``box`` get of ``samples``, sorted by pixel and depth."""
        keys = [samples[c] for c in ("s", "back", "front") if c in samples.columns]
        order = np.lexsort(keys)
        first = starts_of(*(k[order] for k in keys))
        ties = np.diff(np.append(first, samples.size))
        group = ids_of(first, samples.size)
        # in the order of depth, s and entry: of samples at one depth with one s, all have their first entry, then all the next
        place = (first[group] * len(self) + np.arange(samples.size) - first[group])[:, None] + np.arange(len(self)) * ties[group][:, None]
        of, entry = (np.empty(place.size, np.int64) for _ in range(2))
        of[place], entry[place] = order[:, None], np.arange(len(self))
        x, y = (samples[c].astype(np.int64)[of] + d[entry] for c, d in (("x", self.dx), ("y", self.dy)))
        into = np.flatnonzero((x >= box[0]) & (x < box[2]) & (y >= box[1]) & (y < box[3]))
        at = into[by_number((y[into] - box[1]) * (box[2] - box[0]) + x[into] - box[0])]
        return Scattered(samples, of[at], entry[at], x[at], y[at], self)

    def regions(self, samples: Samples, box: Box) -> Iterator[tuple[Samples, Box]]:
        """Boxes that make up ``box``, each with the samples that reach into it, so that few enough are scattered at a time."""
        x, y = samples["x"], samples["y"]
        near = np.flatnonzero((x >= box[0] - self.rx) & (x < box[2] + self.rx) & (y >= box[1] - self.ry) & (y < box[3] + self.ry))
        w, h = box[2] - box[0], box[3] - box[1]
        if not len(near) or w <= 0 or h <= 0:
            return
        samples = samples.take(near) if len(near) < samples.size else samples
        if len(near) * len(self) <= SCATTERED or w * h == 1:
            yield samples, box
            return
        middle = (box[0] + w // 2, box[1] + h // 2)
        for half in ([(box[0], box[1], middle[0], box[3]), (middle[0], box[1], box[2], box[3])] if w >= h else [(box[0], box[1], box[2], middle[1]), (box[0], middle[1], box[2], box[3])]):
            yield from self.regions(samples, half)


@dataclass(frozen=True)
class Scattered:
    """Samples that pixels get, by the sample they are made ``of`` and the kernel's ``entry``; columns are made for those asked for."""

    samples: Samples
    of: np.ndarray
    entry: np.ndarray
    x: np.ndarray
    y: np.ndarray
    kernel: Kernel

    @property
    def size(self) -> int:
        return len(self.of)

    @property
    def starts(self) -> np.ndarray:
        return starts_of(self.x, self.y)

    def __getitem__(self, name: str) -> np.ndarray:
        """A column that places samples in depth, as it was."""
        return self.samples[name][self.of]

    def take(self, at: np.ndarray) -> Samples:
        """s is renumbered, so that it stays a total order."""
        of, entry = self.of[at], self.entry[at]
        made = {"x": self.x[at], "y": self.y[at]}
        for c, v in self.samples.columns.items():
            if c == "s":
                made[c] = v[of].astype(np.int64) * len(self.kernel) + entry
            elif c in ("front", "back"):
                made[c] = v[of]
            elif c not in made:
                made[c] = v[of] * self.kernel.weight[entry]
        return Samples({c: made[c] for c in self.samples.columns})


def _dealt(df: DataFrame, kernel: Kernel, side: int) -> DataFrame:
    """The samples by the tile (_tx, _ty) they are needed in: their own, and those that they reach."""

    def tiles(c: str, reach: int) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side)))

    rows = df.select("*", tiles("x", kernel.rx).alias("_tx")).select("*", tiles("y", kernel.ry).alias("_ty"))
    return rows.repartition("_tx", "_ty").sortWithinPartitions("_tx", "_ty")


def _blurred(image: DeepImage, width: float, height: float, quality: str, merge_tolerance: float, color_tolerance: float, max_samples: int, box: Box | None, correct: bool = False) -> DeepImage:
    rx, ry = radius(width), radius(height)
    if rx == 0 and ry == 0:
        return image
    if box is not None:
        image = image.request(grown(box, rx, ry))
    kernel = Kernel(plane_kernel(width, height, quality))
    side = max(SIDE, REACHES * max(kernel.rx, kernel.ry))
    names, target, compared = image.df.columns, to_arrow_schema(image.df.schema), unpremultiplied(color_tolerance)

    def made(table: pa.Table, tx: int, ty: int) -> Iterator[pa.RecordBatch]:
        x0, y0, x1, y1 = tx * side, ty * side, (tx + 1) * side, (ty + 1) * side
        if box is not None:
            x0, y0, x1, y1 = max(x0, box[0]), max(y0, box[1]), min(x1, box[2]), min(y1, box[3])
        with np.errstate(all="ignore"):
            for samples, region in kernel.regions(Samples(to_arrays(table, names)), (x0, y0, x1, y1)):
                scattered = kernel.scattered(samples, region)
                if scattered.size:
                    out = frontmost(scattered, merge_tolerance, compared, max_samples)
                    yield to_batch(_corrected(out) if correct else out, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tile = None
        for batch in batches:
            keys = [batch.column(n).to_numpy() for n in ("_tx", "_ty")]
            starts = starts_of(*keys)
            for lo, hi in zip(starts, np.append(starts[1:], batch.num_rows)):
                key = (int(keys[0][lo]), int(keys[1][lo]))
                if held and key != tile:
                    yield from made(pa.Table.from_batches(held), *tile)
                    held = []
                held.append(batch.slice(lo, hi - lo))
                tile = key
        if held:
            yield from made(pa.Table.from_batches(held), *tile)

    out = _dealt(image.df, kernel, side).mapInArrow(run, image.df.schema)
    whole = image

    def part(asked: Box) -> DeepImage:
        return _blurred(whole, width, height, quality, merge_tolerance, color_tolerance, max_samples, asked if box is None else common(asked, box), correct)

    return image.but(df=out, bbox=box or (lambda: grown(image.bbox, rx, ry)), recipe=part)


def blur(image: DeepImage, blur_width: float = 1.0, blur_height: float = 1.0, max_samples: int = 100, merge_tolerance: float = 0.001, color_tolerance: float = 0.01, box: Box | None = None) -> DeepImage:
    """A Gaussian over the whole window. Depths are kept; every other channel is weighted."""
    return _blurred(image, blur_width, blur_height, "medium", merge_tolerance, color_tolerance, max_samples, box)


def blur2(image: DeepImage, blur_size: tuple[float, float] = (1.0, 1.0), kernel_quality: str = "medium", alpha_correction: bool = False, max_samples: int = 100, merge_tolerance: float = 0.001, color_tolerance: float = 0.01, box: Box | None = None) -> DeepImage:
    """The separable blur in three qualities. Its two passes have the same samples as one with the product of the weights.

    ``alpha_correction`` is as ``corrected``, done where a pixel's samples are made, so that these aren't shuffled for it."""
    return _blurred(image, *blur_size, kernel_quality, merge_tolerance, color_tolerance, max_samples, box, alpha_correction and "alpha" in image.df.columns)


def _corrected(samples: Samples) -> Samples:
    """``corrected`` of sorted samples: alphas are added from front to back."""
    before = np.zeros(samples.size)
    for _, at, n in blocks(samples.starts, samples.size):
        added, inside = np.add.accumulate(samples.alpha[at[:-1]], axis=0), np.arange(1, len(at))[:, None] < n
        before[at[1:][inside]] = added[inside]
    let = np.where(1 - before > 1e-6, 1 - before, 1.0)
    return Samples({c: v if c in PLACE else v / let for c, v in samples.columns.items()})


@per_pixel
def corrected(image: DeepImage) -> DeepImage:
    """Divide each sample by what the corrected samples before it let through.

    That is 1 less the sum of the alphas before: a corrected alpha is alpha / T, so T goes down by alpha itself."""
    before = pixel_window(image.df).rowsBetween(Window.unboundedPreceding, -1)
    let = 1 - F.coalesce(F.sum("alpha").over(before), F.lit(0.0))
    rows = image.df.withColumn("_t", F.when(let > 1e-6, let).otherwise(F.lit(1.0)))
    return image.with_df(rows.select(*[(F.col(c) if c in PLACE else F.col(c) / F.col("_t")).alias(c) for c in image.df.columns]))
