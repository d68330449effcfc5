"""Pixels that keep so many groups are tidied no deeper than those need, and come out as if they were tidied whole."""

import numpy as np
import pytest

from lamella.functions.kernels import plane_kernel
from lamella.operators import blur as B
from lamella.operators import tidy as Y
from lamella.operators.walk import Samples, merged

NAMES = ("x", "y", "s", "front", "back", "alpha", "red", "green", "blue")


def drawn(seed: int, pixels: int, most: int, depths: int, backward: float = 0.0) -> Samples:
    """Sorted samples: ties, points, faint alphas, opaque ones, and a share whose back is before their front."""
    r = np.random.default_rng(seed)
    pixel = np.repeat(np.arange(pixels), r.integers(1, most + 1, pixels))
    n = len(pixel)
    front = r.integers(0, depths, n) / 8
    back = front + r.integers(0, 6, n) / 16 * np.where(r.random(n) < backward, -1, 1)
    alpha = r.choice([0.0, 5e-7, 2e-6, 0.1, 0.5, 1.0], n)
    s = np.arange(n)
    order = np.lexsort((s, back, front, pixel))
    made = dict(zip(NAMES, (pixel % 7, pixel // 7, s, front, back, alpha, *(alpha * r.integers(0, 4, n) / 4 for _ in range(3)))))
    return Samples({c: v[order] for c, v in made.items()})


def rows(samples: Samples) -> np.ndarray:
    made = np.array([samples[c] for c in NAMES])
    return made[:, np.lexsort([samples[c] for c in ("s", "back", "front", "x", "y")])]


@pytest.mark.parametrize("cap", [0, 1, 3, 20])
@pytest.mark.parametrize("backward", [0.0, 0.2])
@pytest.mark.parametrize("tolerances", [(0.05, 0.05), (0.3, 0.3), (0.0, 0.0), (5.0, 0.0)])
def test_the_frontmost_groups_are_those_of_whole_pixels(cap, backward, tolerances):
    compared = Y.unpremultiplied(tolerances[1])
    with np.errstate(all="ignore"):
        for seed, depths in enumerate((1, 12, 90, 400)):
            samples = drawn(seed, 40, 120, depths, backward)
            found, wanted = (rows(x) for x in (Y.frontmost(samples, tolerances[0], compared, cap), merged(Y.tidied(samples), tolerances[0], compared, cap)))
            assert np.array_equal(found, wanted)


def test_a_piece_that_a_sample_behind_cuts_is_not_judged_uncut():
    """The second piece is faint, and so in the group of the first, only as the sample where the first depth is cuts it short."""
    made = [(0, 0, 0, 1.0, 3.0, 3e-6, 2e-6, 0.0, 0.0), (0, 0, 1, 1.0, 1.0, 0.5, 0.0, 0.0, 0.5), (0, 0, 2, 1.5, 1.5, 0.5, 0.0, 0.5, 0.0), (0, 0, 3, 9.0, 9.0, 0.5, 0.0, 0.5, 0.0)]
    samples = Samples({c: np.array(v) for c, v in zip(NAMES, zip(*made))})
    compared = Y.unpremultiplied(0.05)
    for cap in (1, 2, 3):
        assert np.array_equal(rows(Y.frontmost(samples, 0.05, compared, cap)), rows(merged(Y.tidied(samples), 0.05, compared, cap)))


def test_scattered_samples_are_sorted_and_numbered():
    samples, kernel, box = drawn(9, 49, 9, 12), B.Kernel(plane_kernel(1, 2, "high")), (1, 1, 6, 5)
    made = kernel.scattered(samples, box)
    out = made.take(np.arange(made.size))
    wanted = []
    for i in range(samples.size):
        for e in range(len(kernel)):
            x, y = int(samples["x"][i] + kernel.dx[e]), int(samples["y"][i] + kernel.dy[e])
            if box[0] <= x < box[2] and box[1] <= y < box[3]:
                wanted.append((y, x, samples["front"][i], samples["back"][i], samples["s"][i] * len(kernel) + e, samples["red"][i] * kernel.weight[e]))
    assert list(zip(*[out[c].tolist() for c in ("y", "x", "front", "back", "s", "red")])) == sorted(wanted)
    first = made.take(np.arange(0, made.size, 3))
    assert all(np.array_equal(first[c], out[c][::3]) for c in NAMES)


@pytest.mark.parametrize("size", [(1, 1), (1, 2)])
def test_the_work_follows_what_is_kept(monkeypatch, size):
    """Tidied samples for 20 kept ones in each of 64 pixels, of 4000 that each gets: a few times 20, not 4000."""
    kernel = B.Kernel(plane_kernel(*size, "high"))
    n = 4000 // len(kernel)
    at = np.arange(64 * n)
    samples = Samples(dict(zip(NAMES, (at // n % 8, at // n // 8, at % n, at % n * 0.5, at % n * 0.5 + 0.25, *np.full((4, len(at)), 0.1)))))
    sizes = []
    tidied = Y.tidied
    monkeypatch.setattr(Y, "tidied", lambda x: sizes.append(x.size) or tidied(x))
    out = Y.frontmost(kernel.scattered(samples, (0, 0, 8, 8)), 0.05, Y.unpremultiplied(0.05), 20)
    assert out.size == 64 * 20
    assert sum(sizes) < 64 * 20 * len(kernel) * 4 < 64 * 4000 // 2
