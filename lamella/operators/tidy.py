"""Volumes without overlaps, and the sample optimiser that blurs end with.

Tidying is a sweep over the sorted depths of a pixel: between two neighbouring fronts or backs the same volumes are active, each
cut to that interval, and laid over each other there. Intervals are taken in blocks with about ``PIECES`` cut pieces, of which
only the composites stay, so the work follows the pieces and the memory the samples. It needs no iteration to a fixed point, so
it ends for every input.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..sources.image import PIXEL, PLACE, DeepImage, per_pixel
from .walk import Colours, Samples, blocks, by_number, composite, group_starts, joined, let_through, merged, picked, places, starts_of, totals, walked

FAINT = 1e-6
#: Cut pieces that are held at a time, unless one interval has more.
PIECES = 1 << 17


def powers(base: np.ndarray, exponent: np.ndarray) -> np.ndarray:
    """``base ** exponent`` by the C library, whose last bit numpy's own powers needn't have: the corrected blur magnifies it."""
    return pc.power(pa.array(base), pa.array(exponent)).to_numpy(zero_copy_only=False)


class Sweep:
    """The volumes of all pixels over the intervals between neighbouring depths of their pixel."""

    def __init__(self, samples: Samples):
        n, front, back = samples.size, samples["front"], samples["back"]
        both, of = np.concatenate((front, back)), np.concatenate((samples.pixel, samples.pixel))
        order = np.argsort(both)
        order = order[by_number(of[order])]
        first = starts_of(of[order], both[order])
        self.samples, self.edges, self.pixel = samples, both[order][first], of[order][first]
        rank = np.empty(2 * n, np.int64)
        rank[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, 2 * n)))
        lo, hi = rank[:n], rank[n:]
        volumes, points = np.flatnonzero(hi > lo), np.flatnonzero(hi <= lo)
        for key in (*([samples["s"]] if "s" in samples.columns else []), hi, lo):
            points = points[by_number(key[points])]
        self.points = points
        self.begins = lo[self.points]
        order = volumes[by_number(samples["s"][volumes])] if "s" in samples.columns else volumes
        self.volumes, self.lo, self.hi = order, lo[order], hi[order]
        cover = np.bincount(self.lo, minlength=len(first) + 1) - np.bincount(self.hi, minlength=len(first) + 1)
        self.ends = np.cumsum(np.cumsum(cover)[: len(first)])  # pieces up to each interval

    def intervals(self) -> list[tuple[Samples, np.ndarray]]:
        """What is seen in each interval that a volume covers, block by block, and which edge it begins at."""
        out, at, last = [], 0, len(self.edges)
        entering = by_number(self.lo)
        entered = np.append(0, np.cumsum(np.bincount(self.lo, minlength=last)))
        active = np.empty(0, np.int64)
        while at < last:
            done = int(self.ends[at - 1]) if at else 0
            to = max(at + 1, min(int(np.searchsorted(self.ends, done + PIECES, "right")), at + 65_536, last))
            active = np.sort(np.concatenate((active[self.hi[active] > at], entering[entered[at] : entered[to]])))
            if len(active):
                out.append(self.block(active, at, to))
            at = to
        return out

    def block(self, active: np.ndarray, at: int, to: int) -> tuple[Samples, np.ndarray]:
        """The composites of intervals ``at`` to ``to``; ``active`` are the volumes that reach into them, in compositing order."""
        samples, lo, hi = self.samples, self.lo[active], self.hi[active]
        begin, end = np.maximum(lo, at), np.minimum(hi, to)
        count = end - begin
        of = np.repeat(np.arange(len(active)), count)
        place = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        order = np.argsort((place - at).astype(np.uint16), kind="stable")
        of, place = of[order], place[order]
        source = self.volumes[active][of]
        alpha = samples.alpha[source]
        split = (hi - lo)[of] > 1
        cut, share = alpha.copy(), np.ones(len(source))
        front, back = samples["front"][source[split]], samples["back"][source[split]]
        a, b, whole = self.edges[place[split]], self.edges[place[split] + 1], alpha[split]
        cut[split] = 1 - powers(1 - whole, (b - a) / (back - front))
        share[split] = np.where(whole > FAINT, cut[split] / np.where(whole > FAINT, whole, 1.0), 0.0)
        starts = starts_of(place)
        dealt = list(blocks(starts, len(place)))
        t = let_through(cut, starts, dealt)
        made = {"front": self.edges[place[starts]], "back": self.edges[place[starts] + 1]}
        for c, v in samples.columns.items():
            if c in PIXEL:
                made[c] = v[source[starts]]
            elif c == "s":
                made[c] = np.minimum.reduceat(v[source], starts)
            elif c not in made:
                made[c] = totals((cut if c == "alpha" else v[source] * share) * t, starts, dealt)
        return Samples({c: made[c] for c in samples.columns}), place[starts]


def tidied(samples: Samples) -> Samples:
    if not samples.size:
        return samples
    sweep = Sweep(samples)
    parts = sweep.intervals()
    if not len(sweep.points):
        return joined([p for p, _ in parts])
    # what has no extent covers no interval; of several at one place one sample is made
    order = samples.take(sweep.points)
    starts = starts_of(sweep.begins, order["back"])
    parts.insert(0, (composite(order, starts), sweep.begins[starts]))
    # before the interval that begins at its front; both are sorted, so they are only merged
    return joined([p for p, _ in parts]).take(np.argsort(np.concatenate([e for _, e in parts]), kind="stable"))


class Sorted(Protocol):
    """Samples sorted by pixel and depth, whose columns needn't be made before some are taken."""

    size: int
    starts: np.ndarray

    def __getitem__(self, name: str) -> np.ndarray: ...

    def take(self, at: np.ndarray) -> Samples: ...


def frontmost(samples: Sorted, tolerance: float, compared: Callable[[Samples], Colours] | None, cap: int) -> Samples:
    """The frontmost ``cap`` groups of each pixel's tidied samples, composited (0: all): the same as ``merged(tidied(samples))``.

    A pixel's samples are taken as far as a depth where about ``cap`` lie before. What is tidied there and ends by that depth, and the
    groups that begin there, don't hang on what lies behind; so if more than ``cap`` begin, the first ``cap`` are whole. The
    other pixels are taken anew, twice as far, and so on until nothing is left behind: the work stays in proportion to the samples."""
    if cap <= 0:
        return merged(tidied(samples.take(np.arange(samples.size))), tolerance, compared)
    front, starts = samples["front"], samples.starts
    least = np.fmin(front, samples["back"])  # a depth behind the front may also cut what lies before
    lengths, left, most, out = np.diff(np.append(starts, samples.size)), np.arange(len(starts)), cap, []
    while len(left):
        whole = lengths[left] <= most
        depth = np.where(whole, np.inf, front[starts[left] + np.minimum(most, lengths[left] - 1)])
        of = np.repeat(np.arange(len(left)), lengths[left])
        at = np.arange(len(of)) + (starts[left] - np.cumsum(lengths[left]) + lengths[left])[of]
        near = whole[of] | (least[at] < depth[of])
        part, of = samples.take(at[near]), of[near]
        tidy = tidied(part)
        if tidy.size:
            of = of[part.starts][tidy.pixel]
        begins = group_starts(tidy, tolerance, compared)
        pixel = of[begins]
        sure = whole[pixel] | ((tidy["front"][begins] < depth[pixel]) & (tidy["back"][begins] <= depth[pixel]))
        done = whole | (np.bincount(pixel[sure], minlength=len(left)) > cap)
        out.append(composite(*picked(tidy, begins, done[pixel] & (places(pixel) < cap))))
        left, most = left[~done], most * 2
    return joined(out) if out else samples.take(np.arange(samples.size))


@per_pixel
def tidy(image: DeepImage) -> DeepImage:
    """No two samples of a pixel overlap; equal intervals are one sample."""
    return image.with_df(walked(image.df, tidied))


def unpremultiplied(tolerance: float):
    """Compares unpremultiplied colour; faint samples differ from nothing. None, as colour then doesn't count, for a tolerance of 0 or less."""

    def compared(samples: Samples) -> Colours:
        counts = samples.alpha >= FAINT
        return Colours([c / np.where(counts, samples.alpha, 1.0) for c in samples.colours], counts, tolerance)

    return compared if tolerance > 0 else None


def optimised(df: DataFrame, merge_tolerance: float = 0.001, color_tolerance: float = 0.01, max_samples: int = 100) -> DataFrame:
    return walked(df, lambda x: frontmost(x, merge_tolerance, unpremultiplied(color_tolerance), max_samples))


@per_pixel
def optimize_samples(image: DeepImage, merge_tolerance: float = 0.001, color_tolerance: float = 0.01, max_samples: int = 100) -> DeepImage:
    """Tidy, merge what is near in depth and colour, and keep the frontmost ``max_samples`` (0: all).

    A depth tolerance of 0 or less merges nothing; a colour tolerance of 0 or less lets any colours merge. Colours are the first
    three channels that are there; without alpha, samples are opaque."""
    return image.with_df(optimised(image.df, merge_tolerance, color_tolerance, max_samples))
