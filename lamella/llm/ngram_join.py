"""N-gram Jaccard self-join by vertical partitioning.

A document is the set of its distinct ``k``-word shingles, lower-cased (A-Z), each a 64-bit hash. Equal sets form one class,
named by a hash of the set (``sig``), so copies are joined once. The global order of shingles is cut into fragments (ranges
of the hash); overlaps are counted fragment by fragment and summed for each pair.

A pair needs ``overlap >= share * |x|`` for both sides, so a set may have at most ``|x| - ceil(share * |x|)`` shingles that
no other set has. The steps, all exact:

1. One fragment (``FIRST`` of the hash range) of all classes: a class with more lone shingles than that *in this fragment*
   has no partner (the segment difference filter). Only the rest take part further on.
2. All fragments of the remaining classes give each shingle its number of classes; lone ones are dropped, and the filter is
   applied to the whole set. With shingles ordered by (number of classes, hash), the prefix filter holds: linked classes
   share a shingle of their prefixes. Sharing one makes groups: connected components of prefix sharing, found through
   stars, never through pairs.
3. A group's classes are cut into cells of at most ``BLOCK`` classes (small groups share a cell, pairs of blocks of a large one
   are a cell each). A cell lists its candidate pairs, those that share a prefix shingle and whose sizes allow a link, and its
   sets are cut into ``FRAGMENTS`` ranges of the shingle order. Each (cell, fragment) is counted by a task of its own, which
   knows that fragment alone: a partial overlap for each pair. The partial overlaps are summed by pair, and the sums decide.
4. Of a large group, the pairs with one hub are counted first, by the same steps. What links to the hub is one component
   already, so only blocks with a class outside it go on. Hubs are dealt to the blocks, never joined on their group.

Links leave a task as a spanning forest, so the rows made follow the classes, not their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, TABLE_BYTES, arrow_schema, components, group_arrow, map_arrow, materialise, mix, partitions_for, rolling, sized, slices, spread_join, struct, text_key, text_partitions, to_bytes, word_hashes

#: The fragment that is counted first: this part of the hash range. Must exceed 1 - share to prune; a quarter drops any
#: class of which over 40 % is its own.
FIRST = 1 / 4
#: Classes in a block, and the bytes of their sets; a block has no more of either than this, or one class.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Ranges of the shingle order whose overlaps are counted separately.
FRAGMENTS = 4
#: Shingles that are counted at a time, as one bit each.
COLUMNS = 1 << 16
#: A shingle in more prefixes than this has its star drawn by a broadcast, if the list of such shingles is small enough.
HOT = 512
#: Bytes of text for each range of shingle hashes.
RANGE_BYTES = 40 << 20

_DEALT = struct("part int, ids binary, ties binary, sizes binary, sigs binary, counts binary, hashes binary")
_FIRST = struct("id long, tie long, n long, n_first long, sig long, shared long")
_SEGMENT = struct("sig long, n long, hashes binary, seen binary")
_CLASS = struct("sig long, n long, m long, prefix array<long>, hashes binary")
_EDGE = struct("a long, b long")
_CELL = struct("cell string, fragment int, sigs binary, sizes binary, left binary, right binary, counts binary, hashes binary")
_PARTIAL = struct("cell string, fragment int, sigs binary, sizes binary, left binary, right binary, overlaps binary")


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Fewer than ``k`` words are one shingle; no words, none."""
    words, starts = word_hashes(texts, lower=True)
    hashes = rolling(words, k)
    out = []
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(hashes[lo : hi - k + 1]))
        elif hi > lo:
            out.append(mix(rolling(words[lo:hi], hi - lo) + np.uint64(hi - lo)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> int:
    """A 64-bit name of a set, whatever the order of its members."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(hashes + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64)
        return int(mix(np.asarray([total + np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])


def _part(hashes: np.ndarray, parts: int, share: float = 1.0) -> np.ndarray:
    """The fragment of each hash, of ``parts`` equal ranges that together cover the lower ``share`` of all."""
    return np.minimum((hashes >> np.uint64(32)).astype(np.float64) / (share * 2.0**32) * parts, parts - 1).astype(np.int32)


def _deal(batch: pa.RecordBatch, k: int, parts: int, share: float) -> Iterator[pa.RecordBatch]:
    """The slice's classes with their shingles below ``share`` of the hash range, by fragment; and a row that has all its documents."""
    ids = np.asarray(batch.column(0).fill_null(NULL_ID), np.int64)
    texts = to_bytes(batch.column(1))
    ties = np.asarray(batch.column(2), np.int64)
    sets = shingle_sets(texts, k)
    sigs = np.fromiter((signature(s) for s in sets), np.int64, len(sets))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    limit = np.uint64(min(int(share * 2**64), 2**64 - 1))
    cut = [s if share >= 1 else s[: np.searchsorted(s, limit)] for s in sets]
    some = np.fromiter(map(len, cut), np.int64, len(cut))
    own = np.unique(sigs, return_index=True)[1]
    own = own[some[own] > 0]
    rows: list[tuple] = [(int(sigs[0] % parts), ids.tobytes(), ties.tobytes(), np.concatenate((sizes, some)).tobytes(), sigs.tobytes(), None, None)]
    if len(own):
        hashes, owner = np.concatenate([cut[i] for i in own]), np.repeat(own, some[own])
        part = _part(hashes, parts, share)
        order = np.argsort(part, kind="stable")
        hashes, owner, part = hashes[order], owner[order], part[order]
        edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            first = np.concatenate(([0], np.flatnonzero(np.diff(owner[lo:hi])) + 1))
            docs = owner[lo:hi][first]
            rows.append((int(part[lo]), None, None, sizes[docs].astype("<i4").tobytes(), sigs[docs].tobytes(), np.diff(np.append(first, hi - lo)).astype("<i4").tobytes(), hashes[lo:hi].tobytes()))
    schema = arrow_schema(_DEALT)
    for i in range(0, len(rows), 1000):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[i : i + 1000], strict=True), schema, strict=True)], schema=schema)


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[dict]]:
    """Of one fragment: distinct (hash, class) sorted by hash, the classes' sizes; and the rows that hold documents."""
    hashes, sigs, sizes, rest = [], [], [], []
    for row in table.to_pylist():
        if row["hashes"] is None:
            rest.append(row)
            continue
        counts = np.frombuffer(row["counts"], "<i4")
        hashes.append(np.frombuffer(row["hashes"], np.uint64))
        sigs.append(np.repeat(np.frombuffer(row["sigs"], np.int64), counts))
        sizes.append(np.repeat(np.frombuffer(row["sizes"], "<i4"), counts))
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), rest
    h, s, n = map(np.concatenate, (hashes, sigs, sizes))
    order = np.argsort(h)
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    twice = np.zeros(len(h), bool)
    twice[order[same]] = twice[order[same + 1]] = True
    # only repeated hashes need sorting by class; the classes of several slices count once
    lone = np.flatnonzero(~twice)
    more = np.flatnonzero(twice)
    more = more[np.lexsort((s[more], h[more]))]
    if len(more):
        new = np.ones(len(more), bool)
        new[1:] = (h[more[1:]] != h[more[:-1]]) | (s[more[1:]] != s[more[:-1]])
        more = more[new]
    keep = np.concatenate((lone, more))
    return h[keep], s[keep], n[keep], rest


def _classes_of(hashes: np.ndarray) -> np.ndarray:
    """For each entry the number of entries with its hash."""
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    return counts[inverse]


def _count_first(table: pa.Table) -> pa.Table:
    """The fragment's shared shingles by class, and all documents that came along."""
    h, s, _, rest = _gathered(table)
    shared = np.unique(s[_classes_of(h) > 1], return_counts=True) if len(h) else (np.empty(0, np.int64), np.empty(0, np.int64))
    cols: list[list] = [[None] * len(shared[0]) for _ in range(4)] + [list(shared[0].tolist()), list(shared[1].tolist())]
    for row in rest:
        ids = np.frombuffer(row["ids"], np.int64)
        sizes = np.frombuffer(row["sizes"], np.int64)
        for c, x in zip(cols, (ids, np.frombuffer(row["ties"], np.int64), sizes[: len(ids)], sizes[len(ids) :], np.frombuffer(row["sigs"], np.int64)), strict=False):
            c.extend(x.tolist())
        cols[5].extend([None] * len(ids))
    schema = arrow_schema(_FIRST)
    return pa.table([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _segments(table: pa.Table) -> pa.Table:
    """The fragment's segment of each class: its shared shingles and their numbers of classes."""
    h, s, n, _ = _gathered(table)
    seen = _classes_of(h) if len(h) else h
    keep = seen > 1
    h, s, n, seen = h[keep], s[keep], n[keep], seen[keep]
    order = np.lexsort((h, s))
    h, s, n, seen = h[order], s[order], n[order], seen[order]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(s)) + 1, [len(s)])) if len(s) else np.zeros(1, np.int64)
    rows = [(int(s[lo]), int(n[lo]), h[lo:hi].tobytes(), seen[lo:hi].astype("<i4").tobytes()) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    schema = arrow_schema(_SEGMENT)
    return pa.table([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema, strict=True)], schema=schema)


def _least(n: int, share: tuple[int, int]) -> int:
    return -(-share[0] * n // share[1])


def _classes(batch: pa.RecordBatch, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Whole sets from their segments: those that may have partners, with the shared part of their prefix."""
    rows = []
    for row in batch.to_pylist():
        h = np.concatenate([np.frombuffer(x["hashes"], np.uint64) for x in row["segments"]])
        seen = np.concatenate([np.frombuffer(x["seen"], "<i4") for x in row["segments"]])
        n, m = row["n"], len(h)
        if m < _least(n, share):
            continue
        order = np.lexsort((h, seen))[: m - _least(n, share) + 1]
        rows.append((row["sig"], n, m, h[order].view(np.int64).tolist(), np.sort(h).tobytes()))
    schema = arrow_schema(_CLASS)
    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, schema, strict=True)], schema=schema)


def candidates(prefixes: list[np.ndarray], n: np.ndarray, share: tuple[int, int], blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes that share a prefix shingle and whose sizes allow a link; with ``blocks``, between different blocks only."""
    k = len(prefixes)
    shingles, owner = np.concatenate(prefixes), np.repeat(np.arange(k), np.fromiter(map(len, prefixes), np.int64, k))
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(shingles)) + 1, [len(shingles)]))
    meet = np.zeros((k, k), bool)
    many = np.flatnonzero(np.diff(edges) > 1)
    for lo, hi in zip(edges[many].tolist(), edges[many + 1].tolist(), strict=True):
        meet[owner[lo:hi, None], owner[None, lo:hi]] = True
    a, b = np.nonzero(np.triu(meet, 1))
    fit = share[1] * np.minimum(n[a], n[b]) >= share[0] * np.maximum(n[a], n[b])
    if blocks is not None:
        fit &= blocks[a] != blocks[b]
    return a[fit], b[fit]


def overlaps(hashes: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of common shingles of the pairs (a, b) of sets, which lie end to end in ``hashes``."""
    total = np.zeros(len(a), np.int32)
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1 if len(column) else new
    column, row = column[shared], np.repeat(np.arange(len(counts)), counts)[order][shared]
    if not len(column) or not len(a):
        return total
    column = np.cumsum(np.diff(column, prepend=column[0]) > 0)
    for at in range(0, int(column[-1]) + 1, COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        bits = np.zeros((len(counts), (min(COLUMNS, int(column[-1]) + 1 - at) + 63) // 64), np.uint64)
        place = column[lo:hi] - at
        np.bitwise_or.at(bits, (row[lo:hi], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        step = max(1, (1 << 20) // bits.shape[1])
        for i in range(0, len(a), step):
            total[i : i + step] += np.bitwise_count(bits[a[i : i + step]] & bits[b[i : i + step]]).sum(1, dtype=np.int32)
    return total


def forest(links: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in links:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if (u := root(x)) != (v := root(y)):
                parent[u] = v
                out.append((x, y))
    return out


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    schema = arrow_schema(_EDGE)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 2, schema, strict=True)], schema=schema)


def _cell(name: str, rows: list[tuple], a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A cell (sig, n, hashes of its classes; its pairs) as a head and one row for each fragment, with what the pairs need."""
    if not len(a):
        return
    used = np.unique(np.concatenate((a, b)))
    a, b = np.searchsorted(used, a).astype("<i2").tobytes(), np.searchsorted(used, b).astype("<i2").tobytes()
    sets = [np.frombuffer(rows[i][2], np.uint64) for i in used.tolist()]
    out = [(name, -1, np.asarray([rows[i][0] for i in used.tolist()], np.int64).tobytes(), np.asarray([rows[i][1] for i in used.tolist()], "<i4").tobytes(), a, b, None, None)]
    cuts = [np.searchsorted(x, np.asarray([f * (1 << 64) // FRAGMENTS for f in range(1, FRAGMENTS)], np.uint64)).tolist() for x in sets]
    for f in range(FRAGMENTS):
        segments = [x[(c[f - 1] if f else 0) : (c[f] if f < FRAGMENTS - 1 else len(x))] for x, c in zip(sets, cuts, strict=True)]
        out.append((name, f, None, None, a, b, np.fromiter(map(len, segments), "<i4", len(segments)).tobytes(), np.concatenate(segments).tobytes()))
    schema = arrow_schema(_CELL)
    for row in out:
        yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, schema, strict=True)], schema=schema)


def _small(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Cells of whole groups; the rows (cc, sig, n, hashes, prefix) of a partition are sorted by group."""
    held: list[tuple] = []
    size, last = 0, None

    def cell() -> Iterator[pa.RecordBatch]:  # named after a class, as a task may run several partitions
        yield from _cell(f"small-{held[0][0]}", held, *candidates([h[3] for h in held], np.asarray([h[1] for h in held], np.int64), share))

    for batch in batches:
        group, sigs, n, hashes = (batch.column(i).to_pylist() for i in range(4))
        prefixes = batch.column(4)
        for i, cc in enumerate(group):
            if cc != last and (len(held) >= BLOCK or size >= BLOCK_BYTES):
                yield from cell()
                held, size = [], 0
            last = cc
            held.append((sigs[i], n[i], hashes[i], np.asarray(prefixes[i].values, np.int64)))
            size += len(hashes[i])
    if held:
        yield from cell()


def _rows(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: r["sig"])


def _one_cell(name: str, rows: list[dict], a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.Table.from_batches(_cell(name, [(r["sig"], r["n"], r["hashes"]) for r in rows], a, b), schema=arrow_schema(_CELL))


def _star(table: pa.Table) -> pa.Table:
    """The cell of one block and its group's hub: the pairs with the hub."""
    rows = _rows(table)
    hub = next(i for i, r in enumerate(rows) if r["hub"])
    rest = np.asarray([i for i, r in enumerate(rows) if r["sig"] != rows[hub]["sig"]], np.int64)
    return _one_cell(f"star-{rows[0]['cc']}-{rows[0]['own']}", rows, rest, np.full(len(rest), hub))


def _block(table: pa.Table, share: tuple[int, int]) -> pa.Table:
    """The cell of two blocks of a group, or of one with itself."""
    rows = _rows(table)
    i, j = rows[0]["i"], rows[0]["j"]
    own = None if i == j else np.asarray([r["own"] for r in rows])
    pairs = candidates([np.asarray(r["prefix"], np.int64) for r in rows], np.asarray([r["n"] for r in rows], np.int64), share, own)
    return _one_cell(f"block-{rows[0]['cc']}-{i}-{j}", rows, *pairs)


def _partial(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The overlaps of the pairs of a cell within one fragment."""
    schema = arrow_schema(_PARTIAL)
    for row in batch.to_pylist():
        pairs = [np.frombuffer(row[x], "<i2").astype(np.int64) for x in ("left", "right")]
        made = overlaps(np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["counts"], "<i4"), *pairs)
        yield pa.RecordBatch.from_pylist([{"cell": row["cell"], "fragment": row["fragment"], "overlaps": made.astype("<i4").tobytes()}], schema=schema)


def _summed(table: pa.Table, share: tuple[int, int], every: bool) -> pa.Table:
    """The links of one cell: partial overlaps of its fragments, summed by pair."""
    total = a = b = sigs = n = None
    for row in table.to_pylist():
        if row["fragment"] < 0:
            a, b = (np.frombuffer(row[x], "<i2").astype(np.int64) for x in ("left", "right"))
            sigs, n = np.frombuffer(row["sigs"], np.int64), np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        else:
            part = np.frombuffer(row["overlaps"], "<i4").astype(np.int64)
            total = part if total is None else total + part
    hit = share[1] * total >= share[0] * (n[a] + n[b] - total)
    pairs = sigs[a[hit]], sigs[b[hit]]
    return pa.Table.from_batches([_edges(list(zip(*map(np.ndarray.tolist, pairs), strict=True)) if every else forest([pairs]))])


def _counted(cells: DataFrame, share: tuple[int, int], every: bool) -> DataFrame:
    """Links of written cells: one task counts one fragment of a cell, the counts meet by cell and are summed by pair."""
    apart = cells.where("fragment >= 0").repartition(partitions_for(cells, BLOCK_BYTES), "cell", "fragment")
    heads = cells.where("fragment < 0").select(*[F.lit(None).cast("binary").alias(c) if c == "overlaps" else F.col(c) for c in _PARTIAL.fieldNames()])
    return group_arrow(map_arrow(apart, _partial, _PARTIAL).unionByName(heads).groupBy("cell"), lambda t: _summed(t, share, every), _EDGE)


def classes(docs: DataFrame, id_col: str, text: str, k: int, share: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Every document with its class (id, tie, n, sig), and the classes that may have partners (sig, n, m, prefix, hashes)."""
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), text_key(text, id_col)[1].alias("tie"))
    parts = text_partitions(docs, text, RANGE_BYTES)

    def deal(share_: float, parts_: int):
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "text"):
                yield from _deal(part, k, parts_, share_)

        return run

    first = materialise(group_arrow(map_arrow(keyed, deal(FIRST, parts), _DEALT).groupBy("part"), _count_first, _FIRST), "first", -(-parts // 2))
    members = first.where("id is not null").select("id", "tie", "n", "n_first", "sig")
    shared = first.where("id is null").groupBy("sig").agg(F.sum("shared").alias("shared"))
    lone_allowed = F.floor((F.col("n") * (share[1] - share[0])) / share[1])
    own = members.where("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.first("n_first").alias("n_first"), F.min(F.struct("id", "tie")).alias("rep"))
    may = own.join(shared, "sig", "left").where(F.col("n_first") - F.coalesce("shared", F.lit(0)) <= lone_allowed)
    reps = materialise(may.select(F.col("rep.id").alias("id"), F.col("rep.tie").alias("tie")).distinct(), "representatives", -(-parts // 8))
    kept = keyed.withColumn("_key", F.coalesce("id", F.lit(NULL_ID))).join(sized(reps.withColumnRenamed("id", "_key")), ["_key", "tie"], "left_semi").select("id", "text", "tie")
    segments = group_arrow(map_arrow(kept, deal(1.0, parts), _DEALT).groupBy("part"), _segments, _SEGMENT)
    whole = segments.groupBy("sig").agg(F.first("n").alias("n"), F.collect_list(F.struct("hashes", "seen")).alias("segments"))
    return members, materialise(map_arrow(whole, lambda b: _classes(b, share), _CLASS), "classes", -(-parts // 2))


def _stars(found: DataFrame, parts: int) -> DataFrame:
    """Edges (a, b) from each class to the smallest one that shares a prefix shingle, for every such shingle.

    The smallest classes of frequent shingles are broadcast, or, where those are too many, a hot shingle's classes are dealt to
    many tasks: none gathers its classes in one."""
    prefix = found.select("sig", F.explode("prefix").alias("h"))
    hubs = materialise(prefix.groupBy("h").agg(F.min("sig").alias("b"), F.count("*").alias("c")).where("c > 1"), "hubs", parts)
    hot = materialise(hubs.where(F.col("c") > HOT), "hot", parts)
    counts = hot.select("h", F.col("c").alias("rows"))
    often = spread_join(prefix, hot.select("h", "b"), ["h"], counts=counts)
    rest = spread_join(prefix, hot.select("h"), ["h"], "left_anti", counts=counts).join(hubs.where(F.col("c") <= HOT).select("h", "b"), "h")
    near = often.unionByName(rest)
    return near.select(F.col("sig").alias("a"), "b").where("a <> b").distinct()


def links(found: DataFrame, share: tuple[int, int], every: bool = False) -> DataFrame:
    """Links (a, b) between classes: all of them, or a spanning forest with the same components."""
    parts = partitions_for(found, TABLE_BYTES, 1)
    groups = components(_stars(found, parts), parts=parts)
    named = materialise(found.join(groups.select(F.col("node").alias("sig"), F.col("component").alias("cc")), "sig"), "groups", parts)
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("m") * 8 / BLOCK_BYTES)).cast("int")
    large = materialise(named.groupBy("cc").agg(blocks.alias("blocks"), F.count("*").alias("rows")).where("blocks > 1"), "large", parts)
    counts = large.select("cc", "rows")
    large = large.select("cc", "blocks")
    small = spread_join(named, large, ["cc"], "left_anti", counts=counts).select("cc", "sig", "n", "hashes", "prefix")
    small = small.repartition(partitions_for(named, BLOCK_BYTES), "cc").sortWithinPartitions("cc", "sig")
    cells = small.mapInArrow(lambda it: _small(it, share), _CELL)
    if not large.limit(1).count():
        return _counted(materialise(cells, "cells", parts), share, every)
    whole = spread_join(named, large, ["cc"], counts=counts).withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    main, near = F.lit(False), None
    if not every:
        key = ("cc", "own", "sig", "n", "hashes")
        hub = whole.groupBy("cc", "blocks").agg(F.min_by(F.struct("sig", "n", "hashes"), F.struct(F.col("n") - F.col("m"), "sig")).alias("h"))
        hubs = hub.select("cc", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), "h.*", F.lit(True).alias("hub"))
        stars = whole.select(*key, F.lit(False).alias("hub")).unionByName(hubs).groupBy("cc", "own")
        near = materialise(_counted(materialise(group_arrow(stars, _star, _CELL), "stars", parts), share, True), "near", parts)
        joined = near.select(F.col("a").alias("sig")).unionByName(near.select(F.col("b").alias("sig"))).distinct().withColumn("main", F.lit(True))
        whole = whole.join(joined, "sig", "left")
        main = F.coalesce("main", F.lit(False))
    # blocks of what is one component already come first; pairs of those blocks are left out unless all links are asked for
    sides = whole.withColumn("own", F.col("own") + F.when(main, 0).otherwise(F.col("blocks")))
    dealt = sides.select("cc", "sig", "n", "hashes", "prefix", "own", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") * 2 - 1)).alias("other"))
    if not every:
        dealt = dealt.where("own >= blocks or other >= blocks")
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")
    cells = cells.unionByName(group_arrow(dealt.groupBy("cc", "i", "j"), lambda t: _block(t, share), _CELL))
    out = _counted(materialise(cells, "cells", parts), share, every)
    return out if near is None else out.unionByName(near)


def grouped(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3, share: tuple[int, int] = (9, 10)) -> DataFrame:
    """One row for each document: id and tie (its key), n, sig, and the key ``first`` of its component's first document."""
    members, found = classes(docs, id_col, text, k, share)
    groups = components(links(found, share))
    parts = partitions_for(found, TABLE_BYTES, 1)
    own = members.where("n > 0").groupBy("sig").agg(F.min(F.struct("id", "tie")).alias("first"))
    named = own.join(groups.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "first", F.coalesce("component", "sig").alias("g"))
    named = materialise(named, "named", parts)
    # classes without links are their own group: only the others' first documents have to meet
    least = materialise(named.groupBy("g").agg(F.min("first").alias("least"), F.count("*").alias("rows")).where("rows > 1"), "least", parts)
    by_class = spread_join(named, least.select("g", "least"), ["g"], "left", counts=least.select("g", "rows"))
    by_class = materialise(by_class.select("sig", F.coalesce("least", "first").alias("first")), "components", parts)
    return spread_join(members, by_class, ["sig"], "left").withColumn("first", F.when(F.col("n") > 0, F.col("first")).otherwise(F.struct("id", "tie")))


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3, share: tuple[int, int] = (9, 10)) -> DataFrame:
    """One row for each document: id_col, n_shingles and component_id, the smallest id reachable by links.

    ``share`` is the least Jaccard similarity as a fraction. A null text, or one without words, has no shingles and is its own
    component; repeated rows share theirs. A null id never names a component that has another; a component of null ids
    alone is null. Ids are whole numbers, or strings of digits. An empty table gives no rows; columns other than the two are
    not read, so their names don't matter. Collisions of 64-bit hashes are the only source of error."""
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return grouped(docs, id_col, text, k, share).select(known("id").alias(id_col), F.col("n").alias("n_shingles"), known("first.id").alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3, share: tuple[int, int] = (9, 10)) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id. Documents without words stay, each its own.

    Rows equal in id and text are one document: one of them stays."""
    found = grouped(docs, id_col, text, k, share)
    lost = materialise(found.where(F.col("first") != F.struct("id", "tie")).select(F.col("id").alias("_lamella_id"), F.col("tie").alias("_lamella_tie")).distinct(), "lost", partitions_for(docs, RANGE_BYTES))
    repeated = found.groupBy("id", "tie").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    out = docs.select("*", *text_key(text, id_col)).join(sized(lost), ["_lamella_id", "_lamella_tie"], "left_anti")
    return (out.dropDuplicates(["_lamella_id", "_lamella_tie"]) if repeated else out).select(*docs.columns)


def pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3, share: tuple[int, int] = (9, 10)) -> tuple[DataFrame, DataFrame]:
    """All links (a, b) between classes, and the members of each class (id, tie, n, sig)."""
    members, found = classes(docs, id_col, text, k, share)
    return links(found, share, every=True), members


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join(docs)


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * o >= 90 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a WHERE r.c < e.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(m.c AS BIGINT) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id
"""
