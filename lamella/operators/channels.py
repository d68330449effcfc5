"""Projections: adding, removing and routing channels."""

from __future__ import annotations

from collections.abc import Sequence

import re

from pyspark.sql import functions as F

from ..sources.image import RGBA, DeepImage, per_pixel

#: Routes that take effect, of those that find their channels.
SLOTS = 8
_NUMBER = re.compile(r"\s*([+-]?[0-9]{1,9})")


@per_pixel
def add_channels(image: DeepImage, *sets: Sequence[str]) -> DeepImage:
    """The union of the sets is there afterwards; what is new reads 0."""
    new = [c for c in dict.fromkeys(c for s in sets for c in s) if c not in image.df.columns]
    return image.with_df(image.df.withColumns({c: F.lit(0.0) for c in new})) if new else image


@per_pixel
def remove_channels(image: DeepImage, *sets: Sequence[str], operation: str = "remove") -> DeepImage:
    """Drop the sets' channels, or (``keep``) all others; alpha, depth and z always stay when keeping."""
    named = {c for s in sets for c in s}
    if operation == "remove":
        return image.with_df(image.df.drop(*[c for c in image.channels if c in named]))
    if operation != "keep":
        raise ValueError(f"operation {operation}")
    return image.with_df(image.df.drop(*[c for c in image.channels if c not in named | {"alpha", "z"}]))


@per_pixel
def shuffle4(image: DeepImage, ins: Sequence[str | None] = RGBA, outs: Sequence[str | None] = RGBA) -> DeepImage:
    """Four routes; of those that write a channel the last wins. No output: nothing is written; no input: 0."""
    routes = {o: image.channel(i) for i, o in zip(ins, outs, strict=True) if o is not None}
    return image.with_df(image.df.withColumns(routes)) if routes else image


def parse_routes(matrix: str) -> list[tuple[str, int, str, int]]:
    """The routes ``out:row:source:column`` of a comma-separated string. Malformed ones are left out, what follows a route's fourth
    field or a number's digits is ignored; a string in the former notation, with layer names and dots, has none."""
    if "." in matrix.split(":", 1)[0].split(",", 1)[0]:
        return []
    out = []
    for token in matrix.split(","):
        fields = token.strip().split(":")
        numbers = [_NUMBER.match(f) for f in fields[1:4:2]]
        if len(numbers) == 2 and all(numbers):
            out.append((fields[0].strip(), int(numbers[0][1]), fields[2].strip(), int(numbers[1][1])))
    return out


def format_routes(routes: dict[tuple[str, int], tuple[str, int]]) -> str:
    """Routes by output, in the order of outputs: each output has one source."""
    return ",".join(f"{o}:{i}:{s}:{j}" for (o, i), (s, j) in sorted(routes.items()))


@per_pixel
def shuffle(image: DeepImage, in1: Sequence[str] = RGBA, in2: Sequence[str] = (), out1: Sequence[str] = RGBA, out2: Sequence[str] = (), matrix: str = "") -> DeepImage:
    """Routing by matrix: the first ``SLOTS`` routes that find both their channels are taken, and of those that write one channel the
    first wins; channels without a route pass through."""
    found = []
    for out, i, source, j in parse_routes(matrix):
        target, layer = out2 if out == "out2" else out1, in2 if source == "in2" else in1
        if 0 <= i < len(target) and (source == "const" or 0 <= j < len(layer)):
            found.append((target[i], F.lit(0.0 if j == 0 else 1.0) if source == "const" else image.channel(layer[j])))
    made = {}
    for target, value in found[:SLOTS]:
        made.setdefault(target, value)
    return image.with_df(image.df.withColumns(made)) if made else image


def layers(image: DeepImage) -> list[str]:
    """Layer names, ``none`` first: ``rgba`` for the four unprefixed channels."""
    names = ["rgba" if c in RGBA else c.rsplit("_", 1)[0] if "_" in c else c for c in image.channels]
    return ["none", *[n for n in dict.fromkeys(names) if n != "other"]]
