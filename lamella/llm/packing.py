"""Concatenate and cut: token streams of all documents, end to end, cut into sequences of ``length`` tokens.

Pass 1 tokenises each text once and writes its ids with the place they have in their partition's stream. The token totals of
the partitions, summed in partition order, are the partitions' global offsets. Pass 2 adds the two, so each document knows
its global place, and cuts it at the multiples of ``length``. The records on either side of a cut are boundary records: they
carry on (``continues``) or go on in the next sequence (``continued``). Only the last sequence can be short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import arrow_schema, bounded_batches, map_arrow, materialise, others, released, sized, slices, struct, to_bytes, vacate

LENGTH, END = 2048, 1

_ROW = struct("part long, place long, tokens long, ids binary")
_PIECE = struct("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, continues boolean, continued boolean")


def tokenised(docs: DataFrame, text: str = "text", tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Written rows of ``docs`` without ``text``, with part, place (in the partition's stream), tokens and ids (little-endian uint32).

    A null text counts as empty: it has the end token alone. Retried tasks write the same rows under the same partition;
    what is read later is the one committed copy."""
    bounded_batches(docs)
    path = tokenizer or bpe.default_path()
    kept = others(docs, [text, *_ROW.fieldNames()])
    out = T.StructType(kept + _ROW.fields)
    target = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = bpe.encoder(path), TaskContext.get().partitionId(), 0
        vacate(f"bpe {path}")
        for batch in batches:
            for piece in slices(batch, text, bpe.SLICE_BYTES):
                flat, starts = encoder.encode(to_bytes(piece.column(piece.schema.get_field_index(text))))
                n = piece.num_rows
                ids = np.insert(flat, starts[1:], end).astype("<u4")
                ends = starts[1:] + np.arange(1, n + 1)
                begin = ends - np.diff(starts) - 1
                offsets = np.concatenate(([0], ends * 4)).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])
                made = [np.full(n, part, np.int64), at + begin, ends - begin]
                at += int(ends[-1]) if n else 0
                cols = [piece.column(piece.schema.get_field_index(f.name)) for f in kept] + [pa.array(x, type=pa.int64()) for x in made] + [packed]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, target, strict=True)], schema=target)
            batch = piece = cols = packed = None
            released()

    return materialise(docs.select(*[f.name for f in kept], text).mapInArrow(run, out), "tokens")


def offsets(rows: DataFrame) -> DataFrame:
    """The global offset of each partition of the written rows: an exclusive prefix sum of one number a partition."""
    totals = rows.groupBy("part").agg(F.sum("tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return materialise(totals.select("part", F.coalesce(before, F.lit(0)).alias("base")), "offsets")


def cut(rows: DataFrame, length: int = LENGTH, keep_ids: bool = True) -> DataFrame:
    """The pieces of written rows, one row each; with ``keep_ids`` also the ids as an array."""
    placed = rows.join(sized(offsets(rows)), "part").withColumn("place", F.col("place") + F.col("base")).drop("base", "part", "tokens")
    kept = others(placed, ["place", "ids", *_PIECE.fieldNames()])
    out = T.StructType(kept + _PIECE.fields + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []))
    target = arrow_schema(out)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        place = batch.column(batch.schema.get_field_index("place")).to_pylist()
        ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
        source: list[int] = []
        made: list[tuple] = []
        for i, (at, raw) in enumerate(zip(place, ids, strict=True)):
            n, done = len(raw) // 4, 0
            while done < n:
                sequence, offset = divmod(at + done, length)
                take = min(length - offset, n - done)
                piece = raw[4 * done : 4 * (done + take)]
                source.append(i)
                made.append((done, take, zlib.crc32(piece), n, sequence, offset, done > 0, done + take < n, *([np.frombuffer(piece, "<i4")] if keep_ids else [])))
                done += take
        where = pa.array(source, type=pa.int64())
        cols = [batch.column(batch.schema.get_field_index(f.name)).take(where) for f in kept]
        new = list(zip(*made, strict=True)) if made else [[]] * (len(target) - len(kept))
        cols += [pa.array(list(x), type=f.type) for x, f in zip(new, list(target)[len(kept) :], strict=True)]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, target, strict=True)], schema=target)

    return map_arrow(placed, run, out)


def pack(docs: DataFrame, text: str = "text", length: int = LENGTH, tokenizer: str | None = None, end: int = END, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: the columns of ``docs`` but ``text``, and start, length, ids_crc32, doc_tokens, sequence_id, offset,
    continues, continued (and ids).

    Null and empty texts are packed as one end token; repeated rows are packed each; an empty table gives no rows; columns of
    ``docs`` named as a result are replaced. A sequence's pieces are found by its id; the last is padded by the reader."""
    return cut(tokenised(docs, text, tokenizer, end), length, keep_ids)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, keep_ids=False)
