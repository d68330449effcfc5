"""Thinning: fewer samples with the same look. Seven passes, each usable alone; ``thin`` runs them in their order.

Passes that depend on what they themselves drop (contribution, grouping) are walks over a pixel's sorted samples; the others are
filters and windows where they stand alone. ``thin`` does all seven in one walk: one shuffle by pixel and one sort.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.image import PLACE, RGB, DeepImage, per_pixel
from .ordered import pixel_window, transmitted
from .walk import FEW, Colours, Samples, merged, ranks, walked


@dataclass(frozen=True)
class Thinning:
    """The passes and their thresholds."""

    depth_clip: bool = False
    z_near: float = 0.0
    z_far: float = 1e10
    cull_transparent: bool = True
    alpha_threshold: float = 0.0
    occlusion_cutoff: bool = True
    occlusion_alpha: float = 0.999
    contribution_cull: bool = True
    contribution_min: float = 0.001
    volumetric_collapse: bool = False
    volume_alpha_max: float = 0.01
    volume_group_size: int = 4
    merge_samples: bool = True
    tolerance: float = 0.01
    color_tolerance: float = 0.01
    max_samples: int = 0


@per_pixel
def depth_clip(image: DeepImage, z_near: float = 0.0, z_far: float = 1e10) -> DeepImage:
    return image.with_df(image.df.where((F.col("front") >= z_near) & (F.col("front") <= z_far)))


@per_pixel
def alpha_cull(image: DeepImage, threshold: float = 0.0) -> DeepImage:
    return image.with_df(image.df.where(image.channel("alpha") > threshold))


@per_pixel
def occlusion(image: DeepImage, cutoff: float = 0.999) -> DeepImage:
    """Drop what lies behind the sample with which accumulated alpha reaches the cutoff; that sample stays."""
    rows = image.df.withColumn("_t", transmitted(image.channel("alpha"), pixel_window(image.df)))
    return image.with_df(rows.where(1 - F.col("_t") < cutoff).drop("_t"))


def alive(samples: Samples, t: Thinning) -> np.ndarray:
    """Passes 1 to 4 as one walk over the sorted samples: what stays."""
    front, alpha = samples["front"], samples.alpha
    live = np.ones(samples.size, bool)
    if t.depth_clip:
        live &= (front >= t.z_near) & (front <= t.z_far)
    if t.cull_transparent:
        live &= alpha > t.alpha_threshold
    if not (t.occlusion_cutoff or t.contribution_cull):
        return live
    covered, added = np.zeros(len(samples.starts)), np.zeros(len(samples.starts))
    ends = np.append(samples.starts[1:], samples.size)
    for k, (run, at) in enumerate(ranks(samples.starts, samples.size)):
        if k and len(run) < FEW:
            for r, i in zip(run.tolist(), at.tolist(), strict=True):
                _alive_rest(alpha, live, i, int(ends[r]), float(covered[r]), float(added[r]), t)
            break
        stays, a = live[at], alpha[at]
        if t.occlusion_cutoff:
            before = covered[run]
            stays = stays & (before < t.occlusion_alpha)
            covered[run] = np.where(stays, before + a * (1 - before), before)
        before = added[run]
        if t.contribution_cull:
            stays = stays & (a * (1 - before) >= t.contribution_min)
        added[run] = np.where(stays, before + a * (1 - before), before)
        live[at] = stays
    return live


def _alive_rest(alpha: np.ndarray, live: np.ndarray, at: int, end: int, covered: float, added: float, t: Thinning) -> None:
    """The same for what is left of one pixel, a stretch of samples at a time; it ends where nothing behind can stay."""
    most = max(float(alpha[at:end].max(initial=0.0)), 0.0)
    for lo in range(at, end, 4096):
        hi = min(lo + 4096, end)
        hidden = t.occlusion_cutoff and covered >= t.occlusion_alpha
        if hidden or t.contribution_cull and t.contribution_min > 0 and 0 <= added <= 1 and most * (1 - added) < t.contribution_min:
            live[lo:end] = False
            return
        for i, (stays, a) in enumerate(zip(live[lo:hi].tolist(), alpha[lo:hi].tolist(), strict=True), lo):
            if not stays:
                continue
            if t.occlusion_cutoff:
                stays = covered < t.occlusion_alpha
                covered += a * (1 - covered) if stays else 0.0
            if stays and t.contribution_cull:
                stays = a * (1 - added) >= t.contribution_min
            if stays:
                added += a * (1 - added)
            else:
                live[i] = False


@per_pixel
def contribution_cull(image: DeepImage, minimum: float = 0.001) -> DeepImage:
    """Drop samples that add less than ``minimum`` to what was kept before them; what is dropped doesn't accumulate."""
    only = Thinning(cull_transparent=False, occlusion_cutoff=False, contribution_min=minimum)
    return image.with_df(walked(image.df, lambda x: x.take(np.flatnonzero(alive(x, only)))))


def uncollapsed(samples: Samples, live: np.ndarray, alpha_max: float, size: int) -> np.ndarray:
    """What the volumetric pass keeps of the living: the dead break runs."""
    faint = live & (samples.alpha < alpha_max)
    n = np.arange(samples.size)
    head = np.zeros(samples.size, bool)
    head[samples.starts] = True
    # a run goes on where the sample before is faint too and of the same pixel
    begins = faint & (head | ~np.concatenate(([False], faint[:-1])))
    run = np.cumsum(begins)
    place = n - np.maximum.accumulate(np.where(begins, n, 0))
    length = np.bincount(run[faint], minlength=int(run[-1]) + 1)[run]
    return live & ~(faint & ((place // size + 1) * size <= length) & (place % size != 0))


@per_pixel
def volumetric_collapse(image: DeepImage, alpha_max: float = 0.01, group_size: int = 4) -> DeepImage:
    """Of every full block of ``group_size`` faint samples in a row keep the first; the others are dropped, not composited."""
    return image.with_df(walked(image.df, lambda x: x.take(np.flatnonzero(uncollapsed(x, np.ones(x.size, bool), alpha_max, group_size)))))


def premultiplied(tolerance: float):
    """Compares premultiplied colour; None, as colour then doesn't count, for a tolerance of 0 or less."""
    return (lambda samples: Colours(samples.colours, np.ones(samples.size, bool), tolerance)) if tolerance > 0 else None


@per_pixel
def smart_merge(image: DeepImage, tolerance: float = 0.01, color_tolerance: float = 0.01, max_samples: int = 0) -> DeepImage:
    """Composite samples that are near the first of their group in depth and in premultiplied colour.

    A depth tolerance of 0 or less merges nothing; a colour tolerance of 0 or less lets any colours merge."""
    return image.with_df(walked(image.df, lambda x: merged(x, tolerance, premultiplied(color_tolerance), max_samples)))


def thinned(samples: Samples, t: Thinning) -> Samples:
    live = alive(samples, t)
    if t.volumetric_collapse and samples.size:
        live = uncollapsed(samples, live, t.volume_alpha_max, t.volume_group_size)
    return merged(samples.take(np.flatnonzero(live)), t.tolerance if t.merge_samples else 0.0, premultiplied(t.color_tolerance), t.max_samples)


@per_pixel
def thin(image: DeepImage, settings: Thinning | None = None) -> DeepImage:
    """All passes in order, in one walk over the sorted samples."""
    t = settings or Thinning()
    return image.with_df(walked(image.df, lambda x: thinned(x, t)))


def thin_stats(image: DeepImage, settings: Thinning | None = None) -> DataFrame:
    """The statistics of ``thin`` from one walk: each batch of pixels tells how many samples came in and how many stay."""
    t = settings or Thinning()
    kept = [c for c in image.df.columns if c in (*PLACE, "alpha", *RGB)] if set(RGB) <= set(image.df.columns) else image.df.columns

    def count(samples: Samples) -> dict[str, np.ndarray]:
        out = thinned(samples, t).size
        return {n: c[:1] for n, c in samples.columns.items()} | {"n_in": np.array([samples.size]), "n_out": np.array([out])}

    more = [T.StructField("n_in", T.LongType()), T.StructField("n_out", T.LongType())]
    counts = walked(image.df.select(*kept), count, more)
    return _reported(counts.agg(F.coalesce(F.sum("n_in"), F.lit(0)).alias("samples_in"), F.coalesce(F.sum("n_out"), F.lit(0)).alias("samples_out")))


@dataclass(frozen=True)
class Observed:
    """A thinned image, and what a job that writes it counts on its way."""

    image: DeepImage
    before: Observation
    after: Observation

    def report(self) -> dict:
        """samples_in, samples_out, removed, pct and the line that reports them, once a job over the image has ended."""
        n, m = self.before.get["samples_in"], self.after.get["samples_out"]
        pct = (n - m) * 100.0 / n if n else 0.0
        shown = Decimal(repr(pct)).quantize(Decimal("0.1"), ROUND_HALF_UP)  # as the JVM writes it
        return {"samples_in": n, "samples_out": m, "removed": n - m, "pct": pct, "report": f"In: {n} Out: {m} ({shown}% reduction)"}


def observed(image: DeepImage, settings: Thinning | None = None) -> Observed:
    """``thin``, counted by the job that writes its result: no second walk. The counts are of that image's first job."""
    before, after = Observation("thin_in"), Observation("thin_out")
    made = thin(image.with_df(image.df.observe(before, F.count(F.lit(1)).alias("samples_in"))), settings)
    return Observed(made.with_df(made.df.observe(after, F.count(F.lit(1)).alias("samples_out"))), before, after)


def thinner_stats(before: DeepImage, after: DeepImage) -> DataFrame:
    """samples_in, samples_out, removed, pct and the line that reports them, of any two images."""
    return _reported(before.df.agg(F.count("*").alias("samples_in")).join(after.df.agg(F.count("*").alias("samples_out"))))


def _reported(counts: DataFrame) -> DataFrame:
    removed = F.col("samples_in") - F.col("samples_out")
    pct = F.when(F.col("samples_in") > 0, removed * 100.0 / F.col("samples_in")).otherwise(F.lit(0.0))
    out = counts.withColumn("removed", removed).withColumn("pct", pct)
    return out.withColumn("report", F.format_string("In: %d Out: %d (%.1f%% reduction)", "samples_in", "samples_out", "pct"))
