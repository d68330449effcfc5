"""Boxes: filters on x and y, which reach the scan through all operators that made the image."""

from __future__ import annotations

from ..sources.image import Box, DeepImage, common, grown


def adjust_bbox(image: DeepImage, numpixels: tuple[int, int] = (0, 0)) -> DeepImage:
    """Keep the samples inside the box grown (or shrunk) by ``numpixels``; the declared box has a pixel more on each side."""
    w, h = numpixels
    return cropped(image, grown(image.bbox, w, h)).but(bbox=grown(image.bbox, w + 1, h + 1))


def copy_bbox(image: DeepImage, other: DeepImage | None = None) -> DeepImage:
    """Take the other image's box and drop what lies outside it."""
    return cropped(image, (other or image).bbox)


def crop(image: DeepImage, box: Box) -> DeepImage:
    return cropped(image, box)


def cropped(image: DeepImage, box: Box) -> DeepImage:
    made = image.request(box)
    return made.but(recipe=lambda part: image.request(common(box, part)))
