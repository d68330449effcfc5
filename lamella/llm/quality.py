"""Quality rules: robust multivariate outliers by minimum-covariance-determinant (MCD) estimates per language and source.

Counts come from whole texts in one pass over UTF-8 bytes. The base rules fail a text of fewer than 20 words, or with over
30 % of its words in repeated 8-word windows. All others are judged by a vector of four transformed statistics that vary in
every text: word length, punctuation, capitals, and distinct words in blocks of 20. Each (language, source) has a centre and
a scatter, estimated over all its rows by concentration steps: the ``SUBSET`` of rows with the smallest Mahalanobis distances
gives the next centre and scatter, which never raises the determinant, until no determinant falls any more. Two fixed starts
(medians with median deviations; plain moments) run side by side and the smaller determinant wins. Estimates of n rows count
with a weight of n / (n + ``PRIOR``), the language's with the rest, and a language's likewise against that of all rows. A row
is rejected if its distance exceeds the chi-square quantile ``1 - alpha``.

A step is one aggregation: rows add their moments to (group, distance bin), at most some thousand bins a group, so a hot
source is summed before anything moves. Bins are fine (64 to a doubling), and a bin is taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TABLE_BYTES, arrow_schema, discard, group_arrow, map_arrow, materialise, others, partitions_for, sized, slices, spread_join, struct, to_bytes, window_starts, word_hashes
from .common import rolling as rolled

MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
_SYMBOLS = b"#*$%&|<>"
COUNTS = struct("n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_punct long, n_upper long, n_letters long, n_distinct long")
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())

DIMS = ("length", "punctuation", "capitals", "variety")
#: Words in a block whose distinct words are counted; words of usual text that every text is taken to have besides its own.
BLOCK_WORDS, USUAL = 20, 100
#: Part of the rows that an estimate rests on, rows that a prior counts as, tail probability of a rejection.
SUBSET, PRIOR, ALPHA = 0.75, 50, 1e-5
#: Least fall of a log determinant that is worth another step; what keeps a scatter of equal rows from being singular.
TOLERANCE, RIDGE = 1e-3, 1e-7
_BINS = 64
_P = len(DIMS)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(q: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(df / 2, mid / 2) < q else (lo, mid)
    return (lo + hi) / 2


def consistency(subset: float, p: int) -> float:
    """What scales the scatter of the central ``subset`` of normal rows to that of all."""
    return subset / gamma_p(p / 2 + 1, chi2_quantile(subset, p) / 2)


def repeated_words(words: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Of each text, the words in ``k``-word windows that it has twice or more. Equal hashes are compared word by word."""
    at, owner = window_starts(starts, k)
    out = np.zeros(len(starts) - 1, np.int64)
    if not len(at):
        return out
    hashes = rolled(words, k)[at]
    with np.errstate(over="ignore"):
        key = hashes ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return out
    a, b = at[order[same]], at[order[same + 1]]
    true = (owner[order[same]] == owner[order[same + 1]]) & np.all([words[a + i] == words[b + i] for i in range(k)], axis=0)
    depth = np.zeros(len(words) + k + 1, np.int64)
    both = np.unique(np.concatenate((a[true], b[true])))
    depth[both] += 1
    depth[both + k] -= 1
    covered = np.concatenate(([0], np.cumsum(np.cumsum(depth[: len(words)]) > 0)))
    return covered[starts[1:]] - covered[starts[:-1]]


def distinct_words(words: np.ndarray, starts: np.ndarray, block: int) -> np.ndarray:
    """Of each text, the distinct words of its whole blocks of ``block`` words, summed."""
    whole = np.diff(starts) // block
    owner = np.repeat(np.arange(len(whole)), whole)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
    at = starts[:-1][owner] + first * block
    rows = np.sort(words[at[:, None] + np.arange(block)], axis=1) if len(at) else np.empty((0, block), np.uint64)
    return np.bincount(owner, 1 + (rows[:, 1:] != rows[:, :-1]).sum(1), len(whole)).astype(np.int64)


def count_texts(texts: list[bytes | None]) -> dict[str, list | np.ndarray]:
    words, starts = word_hashes(texts)
    out: dict = {f: np.zeros(len(texts), np.int64) for f in COUNTS.fieldNames()}
    out["n_words"] = np.diff(starts)
    out["n_repeat_words"] = repeated_words(words, starts, REPEAT_WINDOW)
    out["n_distinct"] = distinct_words(words, starts, BLOCK_WORDS)
    for i, text in enumerate(texts):
        if text:
            out["word_chars"][i] = len(text.translate(None, b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))))
            out["n_symbols"][i] = len(text) - len(text.translate(None, _SYMBOLS))
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            out["n_lines"][i] = len(lines)
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
            for name, signs in (("n_punct", _PUNCT), ("n_upper", _UPPER), ("n_letters", _LETTERS)):
                out[name][i] = len(text) - len(text.translate(None, signs))
    return out


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``COUNTS``, which replace columns of the same names. A null text counts as empty."""
    kept = others(docs, COUNTS.fieldNames())
    out = T.StructType(kept + COUNTS.fields)
    target = arrow_schema(out)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, text):
            made = count_texts(to_bytes(part.column(part.schema.get_field_index(text))))
            cols = [part.column(part.schema.get_field_index(f.name)) for f in kept] + [pa.array(made[n], type=pa.int64()) for n in COUNTS.fieldNames()]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, target, strict=True)], schema=target)

    return map_arrow(docs, run, out)


def vector() -> list[Column]:
    """The transformed statistics: drawn towards usual values, so that a short text isn't rejected for a word or two."""
    n = F.col("n_words")
    blocks = n - n % BLOCK_WORDS
    return [
        F.log((F.col("word_chars") + 5.0 * USUAL) / (n + USUAL)),
        F.sqrt((F.col("n_punct") + 0.15 * USUAL) / (n + USUAL)),
        F.sqrt((F.col("n_upper") + 0.15 * USUAL) / (F.col("n_letters") + 5.0 * USUAL)),
        F.asin(F.sqrt((F.col("n_distinct") + 0.9 * USUAL) / (blocks + USUAL))),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


_KEYS = ["level", "lang", "source"]
_PARAMS = struct("level int, lang string, source string, start int, rows long, logdet double, centre array<double>, scatter array<double>, inverse array<double>")
_PRIORS = struct("lang string, source string, centre array<double>, inverse array<double>")


def _estimate(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[float, list[float], list[float], list[float]]:
    centre = sums / n
    scatter = np.zeros((_P, _P))
    for (i, j), x in zip(_PAIRS, products / n, strict=True):
        scatter[i, j] = scatter[j, i] = x - centre[i] * centre[j]
    scatter += np.eye(_P) * RIDGE
    return float(np.linalg.slogdet(scatter)[1]), centre.tolist(), scatter.ravel().tolist(), np.linalg.inv(scatter).ravel().tolist()


def _concentrate(table: pa.Table, subset: float) -> pa.Table:
    """The next estimate of one group from its moments by distance bin."""
    rows = sorted(table.to_pylist(), key=lambda r: r["bin"])
    total = sum(r["rows"] for r in rows)
    n, sums, products = 0, np.zeros(_P), np.zeros(len(_PAIRS))
    for r in rows:
        n += r["rows"]
        sums += r["sums"]
        products += r["products"]
        if n >= subset * total:
            break
    logdet, centre, scatter, inverse = _estimate(n, sums, products)
    key = {k: rows[0][k] for k in (*_KEYS, "start")}
    return pa.Table.from_pylist([key | {"rows": total, "logdet": logdet, "centre": centre, "scatter": scatter, "inverse": inverse}], schema=arrow_schema(_PARAMS))


def _moments(df: DataFrame, *keys: str) -> DataFrame:
    x = [F.col("x")[i] for i in range(_P)]
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.array(*[F.sum(v) for v in x]).alias("sums"), F.array(*[F.sum(x[i] * x[j]) for i, j in _PAIRS]).alias("products"))


def _distance(x: str = "x", of: str = "") -> Column:
    off = [F.col(x)[i] - F.col(f"{of}centre")[i] for i in range(_P)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + F.lit(1.0 if i == j else 2.0) * F.col(f"{of}inverse")[i * _P + j] * off[i] * off[j]
    return F.greatest(total, F.lit(0.0))


def estimates(rows: DataFrame, subset: float = SUBSET) -> DataFrame:
    """MCD centre and scatter of each (lang, source), each lang, and all rows. ``rows``: lang, source, x (written).

    A null language or source is a value of its own. A group's row has level 0, 1 or 2 and nulls (as ``""``) above. A row of
    the result: level, lang, source, rows, logdet, centre, scatter (of the central part, not yet scaled)."""
    null = F.lit("\x00")
    lang, source = F.coalesce("lang", null), F.coalesce("source", null)
    levels = F.array(F.struct(F.lit(0).alias("level"), lang.alias("lang"), source.alias("source")), F.struct(F.lit(1).alias("level"), lang.alias("lang"), F.lit("").alias("source")), F.struct(F.lit(2).alias("level"), F.lit("").alias("lang"), F.lit("").alias("source")))
    dealt = rows.select("x", F.explode(levels).alias("g")).select("g.*", "x")
    parts = partitions_for(rows, 8 * TABLE_BYTES, 1)
    middle = lambda x: F.percentile(F.round(x, 4), 0.5)  # noqa: E731  of few different values, however many rows
    medians = materialise(dealt.groupBy(*_KEYS).agg(F.count("*").alias("rows"), F.array(*[middle(F.col("x")[i]) for i in range(_P)]).alias("centre")), "medians", parts)
    off = spread_join(dealt, medians, _KEYS).groupBy(*_KEYS).agg(F.first("rows").alias("rows"), F.first("centre").alias("centre"), F.array(*[middle(F.abs(F.col("x")[i] - F.col("centre")[i])) for i in range(_P)]).alias("mad"))
    spread = [F.pow(F.col("mad")[i] * 1.4826, F.lit(2.0)) + RIDGE for i in range(_P)]
    diagonal = lambda value: F.array(*[value(spread[i]) if i == j else F.lit(0.0) for i in range(_P) for j in range(_P)])
    middles = off.select(*_KEYS, F.lit(0).alias("start"), "rows", F.lit(0.0).alias("logdet"), "centre", diagonal(lambda x: x).alias("scatter"), diagonal(lambda x: 1 / x).alias("inverse"))
    plain = _moments(dealt, *_KEYS).withColumn("start", F.lit(1)).withColumn("bin", F.lit(0))
    plain = group_arrow(plain.groupBy(*_KEYS, "start"), lambda t: _concentrate(t, 1.0), _PARAMS)
    # neither start rests on a subset: any first step is taken
    params = materialise(middles.unionByName(plain).withColumn("logdet", F.lit(float("inf"))).withColumn("active", F.lit(True)), "estimates", parts)
    names = ["logdet", "centre", "scatter", "inverse"]
    while params.where("active").limit(1).count():
        near = spread_join(dealt, params.where("active").select(*_KEYS, "start", "centre", "inverse"), _KEYS)
        binned = _moments(near.withColumn("bin", F.floor(F.log2(_distance() + 1e-6) * _BINS)), *_KEYS, "start", "bin")
        step = group_arrow(binned.groupBy(*_KEYS, "start"), lambda t: _concentrate(t, subset), _PARAMS)
        step = step.select(*_KEYS, "start", F.struct(*names).alias("new"))
        better = F.coalesce(F.col("new.logdet") < F.col("logdet") - TOLERANCE, F.lit(False))
        moved = params.join(step, [*_KEYS, "start"], "left")
        former, params = params, materialise(moved.select(*_KEYS, "start", "rows", *[F.when(better, F.col(f"new.{n}")).otherwise(F.col(n)).alias(n) for n in names], better.alias("active")), "estimates", parts)
        discard(former)
    best = F.min_by(F.struct("rows", "logdet", "centre", "scatter"), F.struct("logdet", "start")).alias("b")
    return materialise(params.groupBy(*_KEYS).agg(best).select(*_KEYS, "b.*"), "estimates", parts)


def _mixed(n: int, own: tuple[np.ndarray, np.ndarray], wider: tuple[np.ndarray, np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray]:
    """An estimate of ``n`` rows and a wider one as one: centre and scatter of the two, mixed with weights n : prior."""
    w = n / (n + prior)
    centre = w * own[0] + (1 - w) * wider[0]
    off = wider[0] - centre
    return centre, w * own[1] + (1 - w) * (wider[1] + np.outer(off, off))


def shrunk(found: DataFrame, subset: float = SUBSET, prior: float = PRIOR) -> DataFrame:
    """Centre and inverse scatter of each (lang, source), scaled, drawn towards its language's, and that towards all rows'."""
    level = lambda n, *keys: found.where(F.col("level") == n).select(*keys, F.struct("rows", "centre", "scatter").alias(f"e{n}"))
    rows = level(0, "lang", "source").join(sized(level(1, "lang")), "lang").crossJoin(F.broadcast(level(2)))  # level 2 is one row
    scale = consistency(subset, _P)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for row in batch.to_pylist():
            parts = [(row[e]["rows"], (np.asarray(row[e]["centre"]), np.reshape(row[e]["scatter"], (_P, _P)) * scale)) for e in ("e0", "e1", "e2")]
            centre, scatter = _mixed(*parts[0], _mixed(*parts[1], parts[2][1], prior), prior)
            out.append({"lang": row["lang"], "source": row["source"], "centre": centre.tolist(), "inverse": np.linalg.inv(scatter).ravel().tolist()})
        yield pa.RecordBatch.from_pylist(out, schema=arrow_schema(_PRIORS))

    return materialise(map_arrow(rows, run, _PRIORS), "priors", partitions_for(found, TABLE_BYTES, 1))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", alpha: float = ALPHA) -> DataFrame:
    """``docs`` with the counts, base_failed, distance (null if base_failed) and kept; input columns of those names are replaced.

    The estimates rest on all rows that pass the base rules, and every such row is judged by those of its (language, source),
    however small: the fewer its rows, the more the language's count. Null languages and sources are values of their own;
    null and empty texts fail the base rules; whole texts are counted, of any length; equal rows are judged alike and each
    counts; an empty table gives no rows."""
    results = ("base_failed", "distance", "kept")
    plain = counted(docs.select(*[f.name for f in others(docs, results)]), text).withColumn("base_failed", base_failed())
    passed = plain.where(~F.col("base_failed"))
    rows = materialise(passed.select(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.array(*vector()).alias("x")), "vectors")
    return verdicts(plain, shrunk(estimates(rows)), lang, source, alpha)


def verdicts(counted_: DataFrame, found: DataFrame, lang: str, source: str, alpha: float) -> DataFrame:
    null, keys = F.lit("\x00"), ["_lamella_l", "_lamella_s"]
    out = counted_.withColumn("_lamella_x", F.array(*vector())).withColumn("_lamella_l", F.coalesce(F.col(lang).cast("string"), null)).withColumn("_lamella_s", F.coalesce(F.col(source).cast("string"), null))
    out = spread_join(out, found.select(F.col("lang").alias("_lamella_l"), F.col("source").alias("_lamella_s"), F.struct("centre", "inverse").alias("_lamella_e")), keys, "left")
    out = out.withColumn("distance", F.when(~F.col("base_failed"), _distance("_lamella_x", "_lamella_e.")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(1 - alpha, _P), F.lit(True))
    return out.withColumn("kept", kept).drop("_lamella_x", "_lamella_e", *keys)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    plain = materialise(counted(docs).drop("text").withColumn("base_failed", base_failed()), "counts")
    rows = plain.where(~F.col("base_failed")).select("lang", "source", F.array(*vector()).alias("x"))
    out = verdicts(plain, shrunk(estimates(materialise(rows, "vectors"))), "lang", "source", ALPHA)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
