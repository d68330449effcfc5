"""Importance resampling towards a target: documents are drawn by how much likelier the target makes their n-grams.

Each task runs a DuckDB of its own over slices of its texts: SQL takes the words, unnests them, windows them into n-grams and
counts buckets of their CRC-32 for each document. Those counts are written as Parquet. Spark sums them by bucket over all
documents and over the target, makes a gain of each bucket, and scores every document. Gumbel noise from the document's id turns
the highest scores into a draw without replacement.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, arrow_schema, map_arrow, materialise, others, slices

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Texts are handed to SQL in slices of this many bytes; a longer text comes in parts of it.
PART_BYTES = 1 << 20
#: What a task's DuckDB may take; a slice needs about a third of it, so nothing goes to a local disk.
MEMORY = "192MB"
_NOT_WORD = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")

#: For each document of a slice, the buckets of its n-grams and how often each comes. A part's first words, as far as they are
#: the part before's last, only complete n-grams across the cut: an n-gram counts in the part where its last word is new.
SQL = """
WITH words AS (SELECT n, old, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT n, old, regexp_extract_all(text, '{word}') AS ws FROM part)),
grams AS (SELECT n, old, i, w AS g1{leads} FROM words WINDOW pos AS (PARTITION BY n ORDER BY i)),
features AS ({features}),
counted AS (SELECT n, crc32(f) % {buckets} AS b, count(*) AS c FROM features GROUP BY ALL)
SELECT n, list(b) AS buckets, list(c) AS counts FROM counted GROUP BY n
"""


def crc32(texts: pa.ChunkedArray) -> pa.Array:
    """CRC-32 of each string's UTF-8 bytes."""
    held = texts.cast(pa.large_binary()).combine_chunks()
    ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1].tolist()
    data = memoryview(held.buffers()[2] or b"")
    crc = zlib.crc32
    return pa.array(np.fromiter((crc(data[a:b]) for a, b in zip(ends, ends[1:])), np.uint32, len(held)))


def statement(most: int, buckets: int) -> str:
    leads = "".join(f", g{k - 1} || ' ' || lead(w, {k - 1}) OVER pos AS g{k}" for k in range(2, most + 1))
    features = " UNION ALL ".join(f"SELECT n, g{k} AS f FROM grams WHERE g{k} IS NOT NULL AND i + {k - 1} > old" for k in range(1, most + 1))
    return SQL.format(word=WORD, leads=leads, features=features, buckets=buckets)


def connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    con.create_function("crc32", crc32, ["VARCHAR"], "UINTEGER", type="arrow")
    return con


def parts(text: bytes, most: int, size: int = PART_BYTES) -> Iterator[tuple[bytes, int]]:
    """``text`` in parts of about ``size`` bytes, cut before a character that is in no word, and how many words at the start of
    each are the last ``most - 1`` of those before. A word longer than a part is in one part."""
    at, carried = 0, []
    while at < len(text) or not at:
        cut = _NOT_WORD.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        piece = text[at:end]
        yield b" ".join([*carried, piece]), len(carried)
        if end >= len(text):
            return
        last = [w for w in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", piece) if w]
        carried = [*carried, *last][-(most - 1) :] if most > 1 else []
        at = end


def bucket_counts(docs: DataFrame, text: str = "text", most: int = 2, buckets: int = 10_000) -> DataFrame:
    """``docs`` without ``text``, with n_words, n_features (runs of 1 to ``most`` words, repeats counted), and the buckets they fall in:
    arrays buckets and counts. A null text has none. A text of any length is worked on in parts."""
    kept = others(docs, ("n_words", "n_features", "buckets", "counts", text))
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    target = arrow_schema(schema)
    names = [f.name for f in kept]
    query = statement(most, buckets)

    def counts(con: duckdb.DuckDBPyConnection, rows: list[int], old: list[int], texts: list[bytes]) -> pa.Table:
        part = pa.table({"n": pa.array(rows, pa.int32()), "old": pa.array(old, pa.int32()), "text": pc.ascii_lower(pa.array(texts, pa.binary()).cast(pa.string()))})
        con.register("part", part)
        return con.sql(query).to_arrow_table()

    def done(con: duckdb.DuckDBPyConnection, texts: list[bytes | None]) -> tuple[list, list, np.ndarray]:
        """Arrays of buckets and of counts for each text, and their sums."""
        bs: list[list] = [[] for _ in texts]
        cs: list[list] = [[] for _ in texts]
        waiting: tuple[list, list, list] = ([], [], [])

        def flush() -> None:
            if waiting[0]:
                made = counts(con, *waiting)
                for n, b, c in zip(made["n"].to_pylist(), made["buckets"], made["counts"], strict=True):
                    bs[n].append(b.values.to_numpy())
                    cs[n].append(c.values.to_numpy())
                for w in waiting:
                    w.clear()

        for n, t in enumerate(texts):
            for piece, old in parts(t or b"", most):
                for w, v in zip(waiting, (n, old, piece), strict=True):
                    w.append(v)
                if len(piece) >= PART_BYTES:  # a part of a longer text: its counts are merged with the other parts'
                    flush()
        flush()
        sums = np.zeros(len(texts), np.int64)
        for n in range(len(texts)):
            if len(bs[n]) > 1:
                total = np.bincount(np.concatenate(bs[n]), np.concatenate(cs[n]))
                bs[n] = [np.flatnonzero(total)]
                cs[n] = [total[bs[n][0]]]
            bs[n], cs[n] = (bs[n][0], cs[n][0]) if bs[n] else (np.empty(0, np.int32), np.empty(0, np.int32))
            sums[n] = cs[n].sum()
        return bs, cs, sums

    def lists(of: list[np.ndarray]) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum([len(x) for x in of]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *of]).astype(np.int32)))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        with connection() as con:
            for rows in slices(batch, text, PART_BYTES):
                texts = rows.column(rows.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
                bs, cs, sums = done(con, texts)
                # w words have w + (w - 1) + ... runs of 1 to most words
                words = np.array([words_of(int(s), most) for s in sums], np.int64)
                cols = [rows.column(rows.schema.get_field_index(n)) for n in names]
                cols = [c.cast(target.field(n).type) if c.type != target.field(n).type else c for c, n in zip(cols, names, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(words), pa.array(sums), lists(bs), lists(cs)], schema=target)

    return map_arrow(docs, run, schema)


def words_of(features: int, most: int) -> int:
    """How many words have so many runs of 1 to ``most`` words."""
    short = most * (most - 1) // 2  # what a text of at least most words lacks of most for each word
    if features >= most * most - short:
        return (features + short) // most
    return next(w for w in range(most + 1) if w * (w + 1) // 2 >= features)


def summed(counted: DataFrame) -> DataFrame:
    """(b, n) over all rows of ``bucket_counts``: each task adds its own up first, so at most a row a bucket and task is shuffled."""
    both = F.arrays_zip(F.col("buckets").alias("b"), F.col("counts").alias("c"))
    return counted.select(F.inline(both)).groupBy("b").agg(F.sum(F.col("c").cast("long")).alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Each bucket's log-ratio of target to source in thousandths, floored; as many numbers as buckets, which is a parameter."""
    s, t = (dict(map(tuple, summed(x).collect())) for x in (source, target))
    whole_s, whole_t = sum(s.values()), sum(t.values())
    return [math.floor(1000 * math.log(float((t.get(b, 0) + 1) * (whole_s + buckets)) / float((s.get(b, 0) + 1) * (whole_t + buckets)))) for b in range(buckets)]


def ranked(scored: DataFrame, least_words: int, share: int) -> DataFrame:
    """``scored`` (written; score, n_words, _lamella_id) with rank: 1, 2, 3... by falling score, ties to the smaller id, for the highest
    ``share`` hundredths of the rows of at least ``least_words``; null for the others.

    Rows are dealt by ranges of the order; a range's ranks begin after the rows of those before it, whose number the driver sums."""
    order = [F.desc("score"), F.asc("_lamella_id"), F.asc("_lamella_tie")]
    able = scored.where(F.col("n_words") >= least_words)
    draws = share * able.count() // 100
    dealt = materialise(able.repartitionByRange(*order).withColumn("_lamella_range", F.spark_partition_id()), "ranges")
    sizes = dict(map(tuple, dealt.groupBy("_lamella_range").count().collect()))
    before, at = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(at)
        at += sizes.get(k, 0)
    starts = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")
    place = F.row_number().over(Window.partitionBy("_lamella_range").orderBy(*order)) + F.get(starts, F.col("_lamella_range"))
    placed = dealt.withColumn("_lamella_rank", place).drop("_lamella_range")
    rank = F.when(F.col("_lamella_rank") <= draws, F.col("_lamella_rank")).cast("long")
    rest = scored.where(~F.coalesce(F.col("n_words") >= least_words, F.lit(False))).withColumn("_lamella_rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).withColumn("rank", rank)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = 2, buckets: int = 10_000, least_words: int = 20, share: int = 25, seed: int = 7) -> DataFrame:
    """``docs`` without ``text``, with n_words, n_features, weight, score and rank.

    weight is the floored mean gain of a document's features (0 if it has none), score adds Gumbel noise from ``seed`` and the
    id. ``share`` hundredths of the documents of at least ``least_words`` are drawn: those with the highest scores have ranks 1, 2,
    3...; ties go to the smaller id, then to the hash of the row. A null text has no words; a null id comes after every other
    and has the noise of an empty one; equal rows are each drawn by themselves; an empty table gives no rows, and with an empty
    target every gain follows the source alone. Columns of ``docs`` named as a result are replaced."""
    results = ("n_words", "n_features", "weight", "score", "rank")
    kept = [f.name for f in others(docs, (*results, text))]
    packed = docs.select(F.struct(*[F.col(c) for c in kept]).alias("_lamella_row"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_lamella_key"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_lamella_id"), F.col(text).alias("_lamella_text"))
    counted = materialise(bucket_counts(packed, "_lamella_text", most, buckets), "buckets")
    wanted = materialise(bucket_counts(target.select(text), text, most, buckets), "target")
    table = F.split(F.lit(",".join(map(str, gains(counted, wanted, buckets)))), ",").cast("array<bigint>")  # one literal of ``buckets`` numbers
    total = F.aggregate(F.arrays_zip(F.col("buckets").alias("b"), F.col("counts").alias("c")), F.lit(0).cast("long"), lambda a, x: a + F.get(table, x["b"]) * x["c"])
    # whole numbers: the quotient goes towards 0, so what is below 0 and has a remainder goes one further down
    floored = F.expr("CASE WHEN n_features = 0 THEN 0 ELSE (_lamella_sum - pmod(_lamella_sum, n_features)) div n_features END")
    first = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_lamella_key")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((first + 0.5) / 4294967296.0)))
    scored = counted.withColumn("_lamella_sum", total).withColumn("weight", floored.cast("long")).withColumn("score", F.col("weight") + noise)
    scored = scored.drop("buckets", "counts", "_lamella_sum", "_lamella_key").withColumn("_lamella_tie", F.xxhash64("_lamella_row", "n_features"))
    return ranked(materialise(scored, "scores"), least_words, share).select(*[F.col("_lamella_row")[c].alias(c) for c in kept], *results)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs.select("doc_id", "text"), target.select("text")).select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 by a table of 256 entries, itself by eight steps of the polynomial, over the hex digits of the bytes
_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
_STEPS = ", ".join(f"s{k} AS (SELECT i, {_STEP.format('v')} AS v FROM s{k - 1})" for k in range(1, 9))
CRC_SQL = f"s0 AS (SELECT i, i AS v FROM range(256) r(i)), {_STEPS}, crc AS (SELECT list(v ORDER BY i) AS t FROM s8)"


def crc_of(value: str) -> str:
    """SQL for the CRC-32 of a string's UTF-8 bytes; ``t`` is the table."""
    byte = f"CAST('0x' || substr(hex({value}), 2 * k - 1, 2) AS BIGINT)"
    codes = f"list_transform(range(1, strlen({value}) + 1), lambda k: {byte})"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295)"


def _features(table: str, key: str) -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""w_{table} AS (SELECT {key} AS id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT {key}, regexp_extract_all({lowered}, '{WORD}') AS ws FROM {table})),
g_{table} AS (SELECT id, w, lead(w) OVER (PARTITION BY id ORDER BY i) AS nx FROM w_{table}),
f_{table} AS (SELECT id, w AS f FROM g_{table} UNION ALL SELECT id, w || ' ' || nx FROM g_{table} WHERE nx IS NOT NULL)"""


OP12_SQL = f"""
WITH {CRC_SQL}, {_features("documents", "doc_id")}, {_features("benchmark", "item_id")},
u AS (SELECT f, CAST({crc_of("f")} AS BIGINT) % 10000 AS b FROM (SELECT DISTINCT f FROM (SELECT f FROM f_documents UNION ALL SELECT f FROM f_benchmark)), crc),
s AS (SELECT b, count(*) AS n FROM f_documents JOIN u USING (f) GROUP BY b), t AS (SELECT b, count(*) AS n FROM f_benchmark JOIN u USING (f) GROUP BY b),
g AS (SELECT i AS b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1e0) * ((SELECT count(*) FROM f_documents) + 10000) / ((coalesce(s.n, 0) + 1e0) * ((SELECT count(*) FROM f_benchmark) + 10000)))) AS BIGINT) AS gain
      FROM range(10000) r(i) LEFT JOIN s ON s.b = i LEFT JOIN t ON t.b = i),
d AS (SELECT id, count(*) AS n, sum(gain) AS total FROM f_documents JOIN u USING (f) JOIN g USING (b) GROUP BY id),
w AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE CAST((total - ((total % n) + n) % n) // n AS BIGINT) END AS weight,
             CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN d ON doc_id = id),
sc AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 5e-1) / 4294967296e0))) AS BIGINT) AS score, n_features >= 39 AS able FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS many FROM sc)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN able AND place <= 25 * many // 100 THEN CAST(place AS BIGINT) END AS rank FROM r
"""
