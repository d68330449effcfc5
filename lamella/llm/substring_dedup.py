"""Substring deduplication by Rabin-Karp hashes of every window of ``window`` words.

1. Map: each slice of texts hashes all its windows. A window that occurs earlier in the same slice is removable there and
   then, so of a passage, however common, a slice sends one row at most: the combining step that keeps hot passages even.
2. The remaining windows are dealt by hash range, packed as arrays: one row for each slice and range. Each range sorts its
   hashes; of equal ones the first (smallest document, then position) stays, the others are removable.
3. The removable windows go back to their documents, where they merge into maximal intervals that are cut from the text.

Beyond ``COARSE`` ranges a slice's rows would hold a window or two. Then windows are dealt by coarse ranges first, and what
meets there is packed anew by range, ``HELD`` windows at a time; of those that repeat in a time, only the first goes on. So the
task of a range gets few entries of a window that all slices have.

A window has a hash of 64 bits, a sum modulo 2**64, and 16 bits of another, a sum modulo a prime. Each has word hashes of its
own, so two windows that the first takes for one, because words of equal hash or an exchange of words leave its sum as it was,
are nothing special to the second.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, arrow_schema, group_arrow, map_arrow, materialise, mix, released, rolling, rolling_prime, runs, seeded_hashes, sized, slices, struct, text_key, text_partitions, to_bytes, vacate, window_starts, with_columns

#: Bytes of text for each hash range; what one task sorts at a time is a small multiple of this.
RANGE_BYTES = 12 << 20
#: The most ranges that a slice is dealt to, and the windows that are packed anew at a time where there are more.
COARSE, HELD = 8192, 2_000_000

_DEALT = struct("part int, hash binary, more binary, ids binary, ties binary, counts binary, steps binary")
_FOUND = struct("part int, ids binary, ties binary, counts binary, begins binary, ends binary")
_CUTS = struct("_lamella_id long, _lamella_tie long, _lamella_cuts array<int>")
_CUT_FIELDS = struct("n_words long, n_removed long, intervals array<int>, kept_text string, kept_sha256 string")


def _planes(x: np.ndarray, width: int) -> bytes:
    """Integers with their bytes transposed, so that the seldom used high bytes compress to nothing."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _from_planes(raw: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def _packed(part: np.ndarray, hashes: np.ndarray, more: np.ndarray, at: np.ndarray, ids: np.ndarray, ties: np.ndarray, ordered: bool = False) -> Iterator[tuple]:
    """Windows as one row for each part, by document; ``ordered``: they come by id, tie and place."""
    order = np.argsort(part, kind="stable") if ordered else np.lexsort((at, ties, ids, part))
    part, hashes, more, at, ids, ties = (x[order] for x in (part, hashes, more, at, ids, ties))
    for lo, hi in _groups(part):
        first = np.concatenate(([0], np.flatnonzero((np.diff(ids[lo:hi]) != 0) | (np.diff(ties[lo:hi]) != 0)) + 1))
        steps = np.diff(at[lo:hi], prepend=0)
        steps[first] = at[lo:hi][first]
        yield int(part[lo]), hashes[lo:hi].tobytes(), more[lo:hi].tobytes(), _planes(np.diff(ids[lo:hi][first], prepend=0), 8), ties[lo:hi][first].tobytes(), _planes(np.diff(np.append(first, hi - lo)), 4), _planes(steps, 4)


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    """hash, more, place, id and tie of each window of a packed row."""
    counts, steps = _from_planes(row["counts"], 4).astype(np.int64), _from_planes(row["steps"], 4).astype(np.int64)
    total, first = np.cumsum(steps), np.cumsum(counts) - counts
    places = (total - np.repeat(total[first] - steps[first], counts)).astype(np.int32)
    ids = np.cumsum(_from_planes(row["ids"], 8).view(np.int64))
    return np.frombuffer(row["hash"], np.uint64), np.frombuffer(row["more"], np.uint16), places, np.repeat(ids, counts), np.repeat(np.frombuffer(row["ties"], np.int64), counts)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _deal(batch: pa.RecordBatch, window: int, parts: int, fine: int) -> Iterator[pa.RecordBatch]:
    """The windows of a slice (id, text, tie), by ``parts`` hash ranges; what is found here already goes to one of ``fine`` parts."""
    ids, texts, ties = np.asarray(batch.column(0).fill_null(NULL_ID), np.int64), to_bytes(batch.column(1)), np.asarray(batch.column(2), np.int64)
    order = np.lexsort((ties, ids))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(ids[order]) != 0) | (np.diff(ties[order]) != 0)
    order = order[new]  # equal rows have equal results: one of them stands for all
    ids, ties = ids[order], ties[order]
    (words, others), starts = seeded_hashes([texts[i] for i in order], (0, 1))
    at, owner = window_starts(starts, window)
    if not len(at):
        return
    hashes, more = rolling(words, window)[at], (rolling_prime(others, window)[at] >> np.uint64(48)).astype(np.uint16)
    by_hash = np.argsort(hashes, kind="stable")
    later = np.zeros(len(at), bool)
    later[by_hash[1:]] = (hashes[by_hash[1:]] == hashes[by_hash[:-1]]) & (more[by_hash[1:]] == more[by_hash[:-1]])
    flags = np.zeros(len(words), bool)
    flags[at[later]] = True
    begin, end = runs(flags)
    local = owner[np.searchsorted(at, begin)]
    keep = ~later
    hashes, more, at, owner = hashes[keep], more[keep], at[keep], owner[keep]
    schema = arrow_schema(_DEALT)
    yield from _batches(_packed(_part(hashes, parts), hashes, more, at - starts[owner], ids[owner], ties[owner], True), schema)
    # no hashes: found already
    found = ((int(ties[local[lo]] % fine), None, None, ids[local[lo] : local[lo] + 1].tobytes(), ties[local[lo] : local[lo] + 1].tobytes(), (begin[lo:hi] - starts[local[lo]]).astype("<i4").tobytes(), (end[lo:hi] - starts[local[lo]]).astype("<i4").tobytes()) for lo, hi in _groups(local))
    yield from _batches(found, schema)


def _first(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Of windows sorted by both hashes: where the first of each one's equals is."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (more[1:] != more[:-1])
    return np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.empty(0, np.int64)


def _redeal(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of coarse ranges, packed anew by ``parts`` ranges without the windows that an earlier place among those held
    has; rows without hashes pass, and those windows come as such."""
    vacate("")
    schema = arrow_schema(_DEALT)
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def packed() -> Iterator[pa.RecordBatch]:
        h, more, places, ids, ties = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((places, ties, ids, more, h))
        h, more, places, ids, ties = (x[order] for x in (h, more, places, ids, ties))
        first = _first(h, more)
        # a place seen twice (the same row read in two slices) is one place, and goes on
        later = (ids != ids[first]) | (ties != ties[first]) | (places != places[first])
        keep = ~later
        yield from _batches(_packed(_part(h[keep], parts), h[keep], more[keep], places[keep], ids[keep], ties[keep]), schema)
        ids, ties, places = ids[later], ties[later], places[later]
        order = np.lexsort((places, ties, ids))
        ids, ties, places = ids[order], ties[order], places[order].astype("<i4")
        edges = np.flatnonzero((np.diff(ids) != 0) | (np.diff(ties) != 0)) + 1
        owners = zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True) if len(ids) else ()
        yield from _batches(((int(ties[lo] % parts), None, None, ids[lo : lo + 1].tobytes(), ties[lo : lo + 1].tobytes(), places[lo:hi].tobytes(), (places[lo:hi] + 1).astype("<i4").tobytes()) for lo, hi in owners), schema)

    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            row = one.to_pylist()[0]
            if row["hash"] is None:
                yield one
                continue
            held.append(_unpacked(row))
            size += len(held[-1][0])
            if size >= HELD:
                yield from packed()
                held, size = [], 0
        released()
    if held:
        yield from packed()


def _groups(x: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(x):
        edges = np.concatenate(([0], np.flatnonzero(np.diff(x)) + 1, [len(x)]))
        yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _judge(table: pa.Table, parts: int) -> pa.Table:
    """Of one hash range: the windows whose hash has an earlier place, and what the slices had found themselves, dealt by document."""
    gone: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
    windows = []
    for row in table.to_pylist():
        if row["hash"] is None:
            begin = np.frombuffer(row["counts"], "<i4").astype(np.int64)
            gone.append((np.repeat(np.frombuffer(row["ids"], np.int64), len(begin)), np.repeat(np.frombuffer(row["ties"], np.int64), len(begin)), begin, np.frombuffer(row["steps"], "<i4").astype(np.int64)))
        else:
            windows.append(_unpacked(row))
    if windows:
        h, x, s, i, t = (np.concatenate(c) for c in zip(*windows, strict=True))
        windows.clear()
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(h), bool)
        twice[1:] |= same
        twice[:-1] |= same
        order = order[twice]
        h, x, i, t, s = h[order], x[order], i[order], t[order], s[order].astype(np.int64)
        order = np.lexsort((s, t, i, x, h))
        h, x, i, t, s = h[order], x[order], i[order], t[order], s[order]
        lead = _first(h, x)
        # a place seen twice (the same row read in two slices) is one place
        later = (i != i[lead]) | (t != t[lead]) | (s != s[lead])
        gone.append((i[later], t[later], s[later], s[later] + 1))
    i, t, b, e = map(np.concatenate, zip(*gone, strict=True))
    part = (mix((i ^ t).view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((b, t, i, part))
    i, t, b, e, part = i[order], t[order], b[order], e[order], part[order]
    rows = []
    for lo, hi in _groups(part):
        first = np.concatenate(([0], np.flatnonzero((np.diff(i[lo:hi]) != 0) | (np.diff(t[lo:hi]) != 0)) + 1))
        rows.append((int(part[lo]), i[lo:hi][first].tobytes(), t[lo:hi][first].tobytes(), np.diff(np.append(first, hi - lo)).astype("<i4").tobytes(), b[lo:hi].astype("<i4").tobytes(), e[lo:hi].astype("<i4").tobytes()))
    schema = arrow_schema(_FOUND)
    return pa.table([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, schema, strict=True)], schema=schema)


def _merge(table: pa.Table, window: int) -> pa.Table:
    """Of one part of the documents: the maximal intervals of removable words of each."""
    rows = table.to_pylist()
    counts = np.concatenate([np.frombuffer(r["counts"], "<i4") for r in rows])
    i, t = (np.repeat(np.concatenate([np.frombuffer(r[n], np.int64) for r in rows]), counts) for n in ("ids", "ties"))
    b, e = (np.concatenate([np.frombuffer(r[n], "<i4") for r in rows]).astype(np.int64) for n in ("begins", "ends"))
    order = np.lexsort((b, t, i))
    i, t, b, e = i[order], t[order], b[order], e[order] + window - 1
    doc = np.zeros(len(i), np.int64)
    doc[1:] = np.cumsum((np.diff(i) != 0) | (np.diff(t) != 0))
    # texts have fewer than 2 ** 31 words, so a document's intervals can't reach into the next one's
    reach = np.maximum.accumulate(e + (doc << 32))
    new = np.ones(len(i), bool)
    new[1:] = b[1:] + (doc[1:] << 32) > reach[:-1]
    first = np.flatnonzero(new)
    begin, end, doc = b[first], reach[np.append(first[1:], len(i)) - 1] & 0xFFFFFFFF, doc[first]
    out = []
    for lo, hi in _groups(doc):
        at = first[lo]
        out.append((int(i[at]), int(t[at]), np.stack((begin[lo:hi], end[lo:hi]), 1).ravel().tolist()))
    schema = arrow_schema(_CUTS)
    return pa.table([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def removals(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """Removable words by document: its key and cuts, the begins and ends of maximal intervals.

    The order of documents is that of their ids; null ids count as the largest, and rows of one id that differ in text are
    ordered by its hash; ids are whole numbers, or strings of digits. Rows equal in id and text are one document: neither removes the other."""
    parts = text_partitions(docs, text, RANGE_BYTES)

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, text):
            yield from _deal(part, window, min(parts, COARSE), parts)

    dealt = map_arrow(docs.select(F.col(id_col).cast("long").alias(id_col), text, text_key(text, id_col)[1]), deal, _DEALT)
    if parts > COARSE:
        dealt = dealt.repartition(COARSE, "part").mapInArrow(lambda batches: _redeal(batches, parts), _DEALT)
    found = group_arrow(dealt.groupBy("part"), lambda t: _judge(t, parts), _FOUND)
    return materialise(group_arrow(found.groupBy("part"), lambda t: _merge(t, window), _CUTS), "removals", -(-parts // 4))


def cut(text: bytes | None, cuts: list[int] | None, whole: bool = True) -> tuple:
    """n_words, n_removed, intervals (begin, end word pairs), the text without them, the digest of the kept words."""
    if not text:
        return 0, 0, [], None if text is None else "", hashlib.sha256(b"").hexdigest()
    words = text.split()
    intervals: list[int] = []
    kept, rest = words, text
    if cuts:
        intervals = cuts
        keep = np.ones(len(words), bool)
        for b, e in zip(cuts[::2], cuts[1::2], strict=True):
            keep[b:e] = False
        kept = list(compress(words, keep.tolist()))
        if whole:
            rest = _cut_text(text, words, cuts[::2], cuts[1::2])
    return len(words), len(words) - len(kept), intervals, rest.decode("utf-8", "replace") if whole else None, hashlib.sha256(b" ".join(kept)).hexdigest()


def _cut_text(text: bytes, words: list[bytes], begin: list[int], end: list[int]) -> bytes:
    """``text`` with white space as it was, from the start of each interval's first word to the start of the word after it cut."""
    places, at = [], 0
    for w in words:
        at = text.index(w, at)
        places.append(at)
        at += len(w)
    places.append(len(text))
    out, last = [], 0
    for b, e in zip(begin, end, strict=True):
        out.append(text[last : places[b]])
        last = places[e]
    return b"".join([*out, text[last:]])


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20, whole: bool = True) -> DataFrame:
    """``docs`` with n_words, n_removed, intervals, kept_text (null unless ``whole``, or if the text is null) and kept_sha256.

    A word is removed if a window over it also starts earlier: in a document of smaller id or earlier in its own. Windows are
    judged on the input. A null or empty text has no words; a text of fewer than ``window`` words keeps them; a table without
    rows gives none. Columns of ``docs`` named as a result are replaced. The removals are broadcast up to
    ``common.BROADCAST_BYTES`` in memory and joined by a shuffle beyond."""
    found = removals(docs, id_col, text, window)
    keyed = docs.select("*", *text_key(text, id_col))
    joined = keyed.join(sized(found), ["_lamella_id", "_lamella_tie"], "left").drop("_lamella_id", "_lamella_tie")
    packed = joined.withColumn("_lamella_cut", F.struct(F.col(text).cast("binary").alias("t"), F.col("_lamella_cuts").alias("cuts"))).drop("_lamella_cuts")

    def apply(col: pa.Array) -> dict:
        done = [cut(t, c, whole) for t, c in zip(to_bytes(col.field("t")), col.field("cuts").to_pylist(), strict=True)]
        return dict(zip(_CUT_FIELDS.fieldNames(), zip(*done, strict=True), strict=True)) if done else {n: [] for n in _CUT_FIELDS.fieldNames()}

    return with_columns(packed if whole else packed.drop(text), "_lamella_cut", _CUT_FIELDS, apply).drop("_lamella_cut")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, whole=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(d.w) AS n, CASE WHEN g.ps IS NULL THEN d.w ELSE list_filter(list_transform(d.w, lambda x, i: CASE WHEN list_contains(g.ps, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) END AS k
         FROM d LEFT JOIN gone g ON d.doc_id = g.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(k) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""
