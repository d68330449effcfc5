"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised benchmark items.

Normalising keeps ``[0-9a-z]`` (A-Z lowered) and every character beyond ASCII; all else separates words. A window is
``window`` consecutive words of an item, or the whole item if it has fewer. Texts and windows are compared as
`` w1 w2 ... `` with one space around each word, so a match always covers whole words and one pass finds all windows,
whatever their lengths. Matches are mapped back to code-point offsets of the untouched text.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TABLE_BYTES, arrow_schema, map_arrow, materialise, partitions_for, resident, runs, struct, to_bytes, with_columns

#: Each byte's image: lower-case ASCII letters, digits and bytes of characters beyond ASCII stay, the rest becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Windows in one automaton (some 60 nodes each), which every Python worker holds. A larger set is scanned in several passes.
MAX_WINDOWS = 100_000

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("hit_words", T.ArrayType(T.IntegerType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)

_WINDOW = struct("i string, w binary")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def item_windows(items: list[tuple[str | None, bytes | None]], window: int) -> dict[bytes, set[str]]:
    """Window (with its spaces) -> ids of the items that have it. An item without an id still marks words, unnamed."""
    found: dict[bytes, set[str]] = defaultdict(set)
    for name, text in items:
        words = words_of(text)
        for i in range(max(len(words) - window + 1, min(len(words), 1))):
            found[b" " + b" ".join(words[i : i + window]) + b" "] |= {name} - {None}
    return found


def automaton(windows: list[tuple[bytes, list[str]]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for text, ids in windows:
        out.add_word(text.decode("latin-1"), (text.count(b" ") - 1, ids))
    out.make_automaton()
    return out


def scan_text(found: ahocorasick.Automaton | None, text: bytes | None, before: np.ndarray | None = None, items: list[str] | None = None) -> dict:
    """The row of ``FIELDS`` for one text; ``before`` and ``items`` are an earlier pass's hit words (begin, end pairs) and items."""
    words = words_of(text)
    row = {"n_words": len(words), "n_hit": 0, "items": items or [], "hit_words": [], "spans": []}
    spans, ids = [] if before is None else list(map(tuple, np.reshape(before, (-1, 2)))), set(items or ())
    if words and found is not None and len(found):
        norm = b" " + b" ".join(words) + b" "
        hits = list(found.iter(norm.decode("latin-1")))
        if hits:
            gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
            ends = np.searchsorted(gaps, [e for e, _ in hits])
            for end, (_, (n, names)) in zip(ends.tolist(), hits, strict=True):
                spans.append((end - n, end))
                ids.update(names)
    if spans:
        depth = np.zeros(len(words) + 1, np.int64)
        pairs = np.asarray(spans, np.int64)
        np.add.at(depth, pairs[:, 0], 1)
        np.add.at(depth, pairs[:, 1], -1)
        begin, end = runs(np.cumsum(depth[:-1]) > 0)
        raw = np.frombuffer(text, np.uint8)
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        places = [m.span() for m in _WORD.finditer(text)]
        row |= {
            "n_hit": int((end - begin).sum()),
            "items": sorted(ids),
            "hit_words": np.stack((begin, end), 1).ravel().tolist(),
            "spans": [{"begin": int(points[places[b][0]]), "end": int(points[places[e - 1][1]])} for b, e in zip(begin, end, strict=True)],
        }
    return row


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids as sorted strings), hit_words (begin, end pairs) and spans (code points).

    Windows are made and counted on the executors. At most about ``max_windows`` of them, a hash range, reach the driver at a
    time and form one automaton, which is built once in each Python worker; a larger benchmark is scanned in further passes,
    each of which extends the hits of the one before. No document moves between tasks, so neither long texts nor hot keys
    matter. A null or empty text has no words; repeated rows are judged alike; an empty benchmark hits nothing; columns of
    ``docs`` named as a result are replaced."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t"))

    def made(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1).to_pylist()[0]
            found = list(item_windows([(one["i"], one["t"])], window))
            for at in range(0, len(found), 10_000):
                w = found[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([one["i"]] * len(w), type=pa.string()), pa.array(w, type=pa.binary())], schema=arrow_schema(_WINDOW))

    windows = materialise(map_arrow(items, made, _WINDOW).groupBy("w").agg(F.array_sort(F.collect_set("i")).alias("ids")), "windows", partitions_for(benchmark, TABLE_BYTES, 1))
    passes = -(-windows.count() // max_windows)
    out = docs
    for n in range(max(passes, 1)):
        part = windows.where(F.pmod(F.xxhash64("w"), F.lit(max(passes, 1))) == n).toLocalIterator()
        sent = spark.sparkContext.broadcast([(bytes(r.w), list(r.ids)) for r in part])
        if n:
            out = materialise(out, "decontaminated")
        out = _pass(out, text, sent, bool(n))
    return out


def _pass(docs: DataFrame, text: str, sent, again: bool) -> DataFrame:
    name = f"windows {uuid.uuid4().hex}"

    def built():
        return resident(name, lambda: automaton(sent.value))

    if not again:
        return with_columns(docs, text, FIELDS, lambda col: _columns([scan_text(built(), t) for t in to_bytes(col)]), name)
    packed = docs.withColumn("_lamella_again", F.struct(F.col(text).alias("t"), "hit_words", "items"))

    def extend(col: pa.Array) -> dict:
        texts, before, items = to_bytes(col.field("t")), col.field("hit_words").to_pylist(), col.field("items").to_pylist()
        return _columns([scan_text(built(), t, np.asarray(b or [], np.int64), i) for t, b, i in zip(texts, before, items, strict=True)])

    return with_columns(packed, "_lamella_again", FIELDS, extend, name).drop("_lamella_again")


def _columns(rows: list[dict]) -> dict:
    return {f: [r[f] for r in rows] for f in FIELDS.fieldNames()}


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
             coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS t
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.r, dw.i, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON d.r = c.r LEFT JOIN named n ON d.r = n.r
"""
