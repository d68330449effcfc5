"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

Each block has binary features of its ancestors' tags and names, its text and its place; neighbouring labels have weights of
their own. The weights maximise the regularised likelihood of labelled pages (``labelled_pages``, a fixed number of them) and
are found by Adam with exact gradients from the forward-backward recursion; a page is labelled by Viterbi.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import struct, to_bytes, with_columns
from .html_blocks import PLAIN, features, leaf_blocks
from .labelled_pages import labelled_page

PAGES, EPOCHS, RATE, RIDGE = 1500, 30, 0.05, 1e-3
_BATCH = 50
_FIELDS = struct("main_text string")


@dataclass(frozen=True)
class Model:
    """weights: feature -> what it adds to a block's score as main text; moves: scores of label pairs (from, to)."""

    weights: dict[str, float]
    moves: tuple[tuple[float, float], tuple[float, float]]

    def label(self, blocks: list[list[str]]) -> list[int]:
        """The most probable labels, by Viterbi."""
        get = self.weights.get
        (m00, m01), (m10, m11) = self.moves
        a, b, back = 0.0, 0.0, []
        for i, f in enumerate(blocks):
            score = sum(get(x, 0.0) for x in f)
            if i:
                from0, from1 = a + m01 > b + m11, a + m00 >= b + m10
                a, b = (a + m00 if from1 else b + m10), (a + m01 if from0 else b + m11) + score
                back.append((0 if from1 else 1, 0 if from0 else 1))
            else:
                b = score
        if not blocks:
            return []
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def likelihood(scores: np.ndarray, mask: np.ndarray, labels: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of padded pages, with its gradients by block score and by move.

    scores, mask, labels: pages x blocks; only label 1 has a score."""
    n, length = scores.shape
    unary = np.stack((np.zeros_like(scores), scores), 2)
    alpha, beta = np.empty((length, n, 2)), np.zeros((length, n, 2))
    alpha[0] = unary[:, 0]
    for t in range(1, length):
        go = _logsum(alpha[t - 1][:, :, None] + moves, 1) + unary[:, t]
        alpha[t] = np.where(mask[:, t, None], go, alpha[t - 1])
    for t in range(length - 2, -1, -1):
        go = _logsum(moves + (unary[:, t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = np.where(mask[:, t + 1, None], go, beta[t + 1])
    total = _logsum(alpha[-1], 1)
    rows = np.arange(n)
    gold = (scores * labels * mask).sum()
    both = mask[:, 1:] & mask[:, :-1]
    gold += (moves[labels[:, :-1], labels[:, 1:]] * both).sum()
    d_scores = (labels - np.exp(alpha[:, :, 1].T + beta[:, :, 1].T - total[:, None])) * mask
    d_moves = np.zeros((2, 2))
    np.add.at(d_moves, (labels[:, :-1][both], labels[:, 1:][both]), 1)
    for t in range(1, length):
        pair = np.exp(alpha[t - 1][:, :, None] + moves + (unary[:, t] + beta[t])[:, None, :] - total[:, None, None])
        d_moves -= (pair * both[:, t - 1, None, None]).sum(0)
    return float(gold - total[rows].sum()), d_scores, d_moves


@cache
def trained(pages: int = PAGES, epochs: int = EPOCHS, first: int = 0) -> Model:
    """The model fitted to labelled pages ``first`` and on: the same for the same arguments."""
    data = []
    names: dict[str, int] = {}
    for seed in range(first, first + pages):
        html, labels = labelled_page(seed)
        found = features(leaf_blocks(html))
        if found:
            assert len(found) == len(labels)
            data.append(([[names.setdefault(x, len(names)) for x in f] for f in found], labels))
    data.sort(key=lambda d: len(d[1]))
    w, moves = np.zeros(len(names)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))]
    rng = np.random.default_rng(0)
    batches = [data[i : i + _BATCH] for i in range(0, len(data), _BATCH)]
    packed = []
    for part in batches:
        length = max(len(y) for _, y in part)
        mask, labels = np.zeros((len(part), length), bool), np.zeros((len(part), length), np.int64)
        cell, column = [], []
        for p, (found, y) in enumerate(part):
            mask[p, : len(y)], labels[p, : len(y)] = True, y
            for t, f in enumerate(found):
                cell += [p * length + t] * len(f)
                column += f
        packed.append((mask, labels, np.asarray(cell), np.asarray(column)))
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(len(packed)):
            mask, labels, cell, column = packed[i]
            scores = np.bincount(cell, w[column], mask.size).reshape(mask.shape)
            _, d_scores, d_moves = likelihood(scores, mask, labels, moves)
            grads = (np.bincount(column, d_scores.ravel()[cell], len(w)) / len(mask) - RIDGE * w, d_moves / len(mask) - RIDGE * moves)
            step += 1
            for k, (x, g) in enumerate(((w, grads[0]), (moves, grads[1]))):
                m, v = state[2 * k], state[2 * k + 1]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({n: float(w[i]) for n, i in names.items()}, tuple(map(tuple, moves.tolist())))


_PLAIN = {f"in {tag}" for tag in PLAIN}


def main_text(model: Model, html: str | None) -> str:
    """The blocks that the chain labels main. Where it labels none, and the page has no element but ``PLAIN`` ones without names,
    nothing sets menus and notices apart from an article: then all blocks are main of which less than half is linked."""
    met: set[str] = set()
    blocks = leaf_blocks(html or "", model.weights, met)
    chosen = [b.text for b, y in zip(blocks, model.label(features(blocks)), strict=True) if y]
    if not chosen and met <= _PLAIN:
        chosen = [b.text for b in blocks if 2 * b.linked < len(b.text)]
    return " ".join(chosen)


def extract(pages: DataFrame, html: str = "html", model: Model | None = None) -> DataFrame:
    """``pages`` with main_text; an input column of that name is replaced.

    A page without any container has what ``main_text`` says; a null or empty page has an empty text; equal pages have equal texts; bytes that aren't UTF-8 become U+FFFD. The whole
    page is read, whatever its length or depth; an empty table gives no rows."""
    fitted = model or trained()

    def run(col: pa.Array) -> dict:
        return {"main_text": [main_text(fitted, None if h is None else h.decode("utf-8", "replace")) for h in to_bytes(col)]}

    return with_columns(pages, html, _FIELDS, run)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
