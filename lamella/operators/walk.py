"""Walks over the sorted samples of pixels, many pixels at a time.

What a sample becomes may hang on what became of those before it (contribution culling, groups anchored at their first sample).
A partition is sorted by pixel and depth, so its pixels come whole; a walk then takes the first sample of all pixels, the
second of all that have one, and so on, with array operations, as long as many pixels have one; what is left of the few that
have more samples is walked by itself. Products and sums run along blocks of pixels with about as many samples. So time and
memory follow the samples, also where one pixel has them all. A null value of a channel reads as 0, a null alpha as 1, as
missing channels do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.image import PIXEL, PLACE, RGB
from .ordered import pixel_window

#: Samples that are worked on at a time, unless one pixel has more.
SAMPLES = 100_000
#: Members of a padded block of runs, unless one run has more.
BLOCK = 1 << 17
#: An array operation over fewer runs takes longer than a step for each.
FEW = 32


class Samples:
    """Columns of samples sorted by pixel and depth."""

    def __init__(self, columns: dict[str, np.ndarray]):
        self.columns = columns
        self.size = len(columns["x"])

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    @cached_property
    def starts(self) -> np.ndarray:
        """Where pixels begin."""
        return starts_of(self["x"], self["y"])

    @cached_property
    def pixel(self) -> np.ndarray:
        """The number of each sample's pixel."""
        return ids_of(self.starts, self.size)

    @cached_property
    def alpha(self) -> np.ndarray:
        return self.columns.get("alpha", np.ones(self.size))

    @property
    def channels(self) -> list[str]:
        return [c for c in self.columns if c not in PLACE]

    @property
    def colours(self) -> list[np.ndarray]:
        """What samples are compared by: red, green, blue as far as they are there, else the first three channels."""
        names = [c for c in RGB if c in self.columns] or [c for c in self.channels if c != "alpha"][:3]
        return [self[c] for c in names]

    def take(self, at: np.ndarray) -> Samples:
        return Samples({n: c[at] for n, c in self.columns.items()})


def joined(parts: Sequence[Samples]) -> Samples:
    """One after the other."""
    return parts[0] if len(parts) == 1 else Samples({c: np.concatenate([p[c] for p in parts]) for c in parts[0].columns})


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def by_number(numbers: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers; those that fit 16 bits are sorted by counting."""
    small = len(numbers) and numbers.min() >= 0 and numbers.max() < 1 << 16
    return np.argsort(numbers.astype(np.uint16) if small else numbers, kind="stable")


def ids_of(starts: np.ndarray, size: int) -> np.ndarray:
    flags = np.zeros(size, np.int64)
    flags[starts[1:]] = 1
    return np.cumsum(flags)


def ranks(starts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For k = 0, 1, ...: which runs have a k-th member (the longest first), and where it is."""
    lengths = np.diff(np.append(starts, size))
    order = np.argsort(-lengths, kind="stable")
    first, left = starts[order], -lengths[order]
    for k in range(-int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(left, -k, "left"))
        yield order[:n], first[:n] + k


def blocks(starts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All runs of more than one member, in blocks of like lengths: which runs they are, the place of each one's k-th member in
    row k (of its last, where it has fewer), and their lengths."""
    lengths = np.diff(np.append(starts, size))
    order = np.argsort(lengths, kind="stable")
    order = order[np.searchsorted(lengths[order], 2) :]
    sizes, at = lengths[order], 0
    while at < len(order):
        most = int(sizes[at]) if sizes[at] < 16 else int(sizes[at]) * 5 // 4
        to = min(int(np.searchsorted(sizes, most, "right")), at + max(1, BLOCK // most))
        n = sizes[at:to]
        yield order[at:to], starts[order[at:to]] + np.minimum(np.arange(int(n[-1]))[:, None], n - 1), n
        at = to


def let_through(alpha: np.ndarray, starts: np.ndarray, dealt: Iterable | None = None) -> np.ndarray:
    """What the samples before let through, within each run: the product of 1 - alpha, multiplied from front to back."""
    t = np.ones(len(alpha))
    for _, at, n in blocks(starts, len(alpha)) if dealt is None else dealt:
        before = np.multiply.accumulate(1 - alpha[at[:-1]], axis=0)
        if n[0] == n[-1]:
            t[at[1:]] = before
        else:
            inside = np.arange(1, len(at))[:, None] < n
            t[at[1:][inside]] = before[inside]
    return t


def totals(values: np.ndarray, starts: np.ndarray, dealt: Iterable) -> np.ndarray:
    """The sum of each run, added from front to back, so that it is the same whatever lies beside it."""
    out = values[starts]
    for run, at, n in dealt:
        out[run] = np.add.accumulate(values[at], axis=0)[n - 1, np.arange(len(n))]
    return out


def composite(samples: Samples, starts: np.ndarray) -> Samples:
    """One sample for each run, its samples laid over each other. Front is the least and back the greatest depth of those seen."""
    if not samples.size:
        return samples
    dealt = list(blocks(starts, samples.size))
    t = let_through(samples.alpha, starts, dealt)
    seen = t > 0
    made = {n: samples[n][starts] for n in PIXEL}
    sums = {n: totals(samples[n] * t, starts, dealt) for n in samples.channels}
    for n in samples.columns:
        if n == "s":
            made[n] = np.minimum.reduceat(samples[n], starts)
        elif n == "front":
            made[n] = np.minimum.reduceat(np.where(seen, samples[n], np.inf), starts)
        elif n == "back":
            made[n] = np.maximum.reduceat(np.where(seen, samples[n], -np.inf), starts)
    return Samples({n: made[n] if n in made else sums[n] for n in samples.columns})


@dataclass(frozen=True)
class Colours:
    """What samples are compared by, and which of them count: two that do differ if a value does by over ``tolerance``."""

    values: list[np.ndarray]
    counts: np.ndarray
    tolerance: float

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for v in self.values:
            out |= np.abs(v[a] - v[b]) > self.tolerance
        return out & self.counts[a] & self.counts[b]


def group_starts(samples: Samples, tolerance: float, compared: Callable[[Samples], Colours] | None) -> np.ndarray:
    """Where groups begin: at a pixel's first sample, and at each that is over ``tolerance`` behind the first of the group before,
    or of another colour than that. A tolerance of 0 or less leaves every sample alone."""
    if tolerance <= 0:
        return np.arange(samples.size)
    front, colours = samples["front"], compared(samples) if compared is not None else None
    begins = np.zeros(samples.size, bool)
    anchor = np.zeros(len(samples.starts), np.int64)
    ends = np.append(samples.starts[1:], samples.size)
    for k, (run, at) in enumerate(ranks(samples.starts, samples.size)):
        if k and len(run) < FEW:
            for r, i in zip(run.tolist(), at.tolist(), strict=True):
                _group_rest(front, colours, tolerance, int(anchor[r]), i, int(ends[r]), begins)
            break
        if k:
            first = anchor[run]
            apart = ~(front[at] - front[first] <= tolerance)
            if colours is not None:
                near = ~apart
                apart[near] = colours.differ(first[near], at[near])
            run, at = run[apart], at[apart]
        begins[at] = True
        anchor[run] = at
    return np.flatnonzero(begins)


def _group_rest(front: np.ndarray, colours: Colours | None, tolerance: float, anchor: int, at: int, end: int, begins: np.ndarray) -> None:
    """Marks the starts of one pixel's groups from ``at`` on, a stretch of samples at a time."""
    values = colours.values if colours is not None else []
    counts = colours.counts if colours is not None else np.zeros(len(front), bool)
    most = colours.tolerance if colours is not None else 0.0
    f, counted, c = float(front[anchor]), bool(counts[anchor]), tuple(float(v[anchor]) for v in values)
    for lo in range(at, end, 4096):
        hi = min(lo + 4096, end)
        stretch = zip(front[lo:hi].tolist(), counts[lo:hi].tolist(), zip(*[v[lo:hi].tolist() for v in values]) if values else [()] * (hi - lo), strict=True)
        for i, (f2, counted2, c2) in enumerate(stretch, lo):
            if not f2 - f <= tolerance or (counted and counted2 and any(abs(x - y) > most for x, y in zip(c2, c))):
                begins[i] = True
                f, counted, c = f2, counted2, c2


def capped(samples: Samples, starts: np.ndarray, cap: int) -> tuple[Samples, np.ndarray]:
    """The first ``cap`` runs of each pixel (0: all)."""
    if cap <= 0 or not samples.size:
        return samples, starts
    return picked(samples, starts, places(samples.pixel[starts]) < cap)


def places(pixel: np.ndarray) -> np.ndarray:
    """How many before it are of the same pixel."""
    first = starts_of(pixel)
    return np.arange(len(pixel)) - np.repeat(first, np.diff(np.append(first, len(pixel))))


def picked(samples: Samples, starts: np.ndarray, keep: np.ndarray) -> tuple[Samples, np.ndarray]:
    """The runs that are to be kept."""
    inside = keep[ids_of(starts, samples.size)] if samples.size else np.empty(0, bool)
    lengths = np.diff(np.append(starts, samples.size))[keep]
    return samples.take(np.flatnonzero(inside)), np.cumsum(lengths) - lengths


def merged(samples: Samples, tolerance: float, compared: Callable[[Samples], Colours] | None, cap: int = 0) -> Samples:
    """Groups composited; the frontmost ``cap`` of each pixel."""
    return composite(*capped(samples, group_starts(samples, tolerance, compared), cap))


def to_arrays(table: pa.Table, names: Sequence[str]) -> dict[str, np.ndarray]:
    """The columns as arrays; nulls of channels read as missing channels do."""
    columns = {}
    for n in names:
        c = table.column(n)
        if c.null_count and n not in PLACE:
            c = c.fill_null(1.0 if n == "alpha" else 0.0)
        columns[n] = c.to_numpy()
    return columns


def to_batch(made: Samples | dict[str, np.ndarray], target: pa.Schema) -> pa.RecordBatch:
    columns = made.columns if isinstance(made, Samples) else made
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in target], schema=target)


def walked(df: DataFrame, fn: Callable[[Samples], dict[str, np.ndarray] | Samples], more: Sequence[T.StructField] = ()) -> DataFrame:
    """``fn`` over the sorted samples of ``df``, whole pixels at a time. It returns the columns of ``df``, and ``more``.

    A window numbers the samples: what it needs, partitions by pixel sorted by depth, is what the walk gets, and a shuffle by
    pixel that is there already serves."""
    schema = T.StructType([*df.schema.fields, *more])
    target, names = to_arrow_schema(schema), df.columns

    def made(table: pa.Table) -> pa.RecordBatch:
        with np.errstate(all="ignore"):
            return to_batch(fn(Samples(to_arrays(table, names))), target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, pixel = 0, None
        for batch in batches:
            keys = [batch.column(n).to_numpy() for n in PIXEL]
            last = int(starts_of(*keys)[-1]) if batch.num_rows else 0
            if size + batch.num_rows >= SAMPLES and (last or pixel != (keys[0][0], keys[1][0])):  # what is held and comes before the last pixel is whole
                ready = [*held, batch.slice(0, last)]
                if size + last:
                    yield made(pa.Table.from_batches(ready))
                held, size, batch = [], 0, batch.slice(last)
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                pixel = (keys[0][-1], keys[1][-1])
        if size:
            yield made(pa.Table.from_batches(held))

    return df.withColumn("_n", F.row_number().over(pixel_window(df))).mapInArrow(run, schema)
