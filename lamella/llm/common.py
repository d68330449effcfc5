"""What the corpus operators share: scratch tables in the cluster's shared folder, Arrow helpers, word hashing, components.

Words here are maximal runs of characters other than ``\\x20`` and ``\\x09-\\x0D``. They are found in the UTF-8 bytes, where
those characters are single bytes, so texts are never decoded.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Multiplier of the rolling hash modulo 2**64: odd, so its powers have an inverse.
BASE = 0x9E3779B97F4A7C15
#: Modulus and multiplier of the second one: a prime, so that nothing but chance makes sums agree; products fit in 64 bits.
PRIME, BASE2 = (1 << 31) - 1, 0x5851F42D
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and has no other machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lamella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lamella/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch_root(spark)}/{uuid.uuid4().hex}/{name}"


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def sweep(spark: SparkSession) -> None:
    """Delete all scratch tables of this application. For the end of a job: results not yet written elsewhere may read them."""
    _delete(spark, _scratch_root(spark))


def materialise(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there, so a lost executor costs only its own tasks.

    With ``parts`` it is written by at most so many tasks, which keeps a narrow table from becoming as many small files as
    there are shuffle partitions."""
    path = scratch_path(df.sparkSession, name)
    (df.coalesce(parts) if parts else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` returned and that nothing will read again."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rsplit("/", 1)[0])


def input_bytes(df: DataFrame) -> int:
    """The size of what the plan reads: the bytes of all its files, whatever columns it takes of them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def text_partitions(df: DataFrame, text: str, bytes_each: int, least: int = 8) -> int:
    """How many buckets to deal ``df`` into so that each has the words of about ``bytes_each`` of the texts, and ``least`` at least.

    The texts are measured, which reads that column once: no other column, encoding or estimate has a say."""
    size = df.agg(F.sum(F.octet_length(F.col(text).cast("binary")).cast("long"))).head()[0] or 0
    return max(least, -(-size // bytes_each))


def partitions_for(df: DataFrame, bytes_each: int, least: int = 8) -> int:
    """How many buckets to deal ``df`` into so that each holds about ``bytes_each`` of its input, and ``least`` at least.

    Where Catalyst has no size (rows from the driver), four for each shuffle partition."""
    size = input_bytes(df)
    known = size < 1 << 60
    return max(least, -(-size // bytes_each) if known else 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def struct(spec: str) -> T.StructType:
    """``"a int, b array<long>"`` as a schema; unlike Spark's own parser it needs no session."""
    out = T.StructType()
    for field in spec.split(","):
        name, kind = field.split()
        out.add(name, T.ArrayType(_TYPES[kind[6:-1]]) if kind.startswith("array<") else _TYPES[kind])
    return out


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


#: Bytes of a batch on its way between the JVM and Python; a row that has more comes alone.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_resident: dict[str, object] = {}


def resident(name: str, build: Callable[[], object]) -> object:
    """What ``build`` makes, kept in this Python worker from task to task until one of another operator runs here."""
    if name not in _resident:
        vacate("")
        _resident[name] = build()
    return _resident[name]


def vacate(keep: str) -> None:
    """Drop what tasks of other operators have left in this worker."""
    for name in [n for n in _resident if n != keep]:
        del _resident[name]


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: it keeps what is freed as it likes
        return None


def released() -> None:
    """Give freed memory back to the system, so that a worker that is used again doesn't keep its greatest task's."""
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def bounded_batches(df: DataFrame) -> None:
    """Bound the bytes of a batch between the JVM and Python, unless the session bounds them closer."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_CONF).rstrip("bB")) <= BATCH_BYTES:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: T.StructType, keep: str = "") -> DataFrame:
    """``mapInArrow`` with a function of one batch; ``keep`` names the resident that it uses."""
    bounded_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate(keep)
        for batch in batches:
            yield from fn(batch)
            del batch
            released()

    return df.mapInArrow(run, schema)


def group_arrow(grouped: GroupedData, fn: Callable[[pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """``applyInArrow`` with a function of one group's table."""

    def run(table: pa.Table) -> pa.Table:
        vacate("")
        size = table.nbytes
        out = fn(table)
        if size > 1 << 20:
            released()
        return out

    return grouped.applyInArrow(run, schema)


#: Rows that an operator without state works on at a time.
BATCH_ROWS = 500


def others(df: DataFrame, results: Iterable[str]) -> list[T.StructField]:
    """The fields of ``df`` that aren't named as a result, in any case, as Spark's names have none."""
    taken = {r.lower() for r in results}
    return [f for f in df.schema.fields if f.name.lower() not in taken]


def with_columns(df: DataFrame, needs: str, fields: T.StructType, fn: Callable[[pa.Array], dict], keep: str = "") -> DataFrame:
    """``df`` with ``fields`` computed from column ``needs``, batch by batch; an input column of the same name is replaced."""
    kept = others(df, fields.fieldNames())
    if len({f.name for f in kept}) < len(kept):
        raise ValueError("column names of the input must differ")
    names = [f.name for f in kept]
    out = T.StructType(kept + fields.fields)
    target = arrow_schema(out)

    def run(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, whole.num_rows, BATCH_ROWS):
            yield computed(whole.slice(at, BATCH_ROWS))

    def computed(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = fn(batch.column(batch.schema.get_field_index(needs)))
        cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
        cols += [x if isinstance(x, pa.Array) else pa.array(x, type=target.field(n).type) for n, x in ((f, made[f]) for f in fields.fieldNames())]
        return pa.RecordBatch.from_arrays([c.cast(t.type) if c.type != t.type else c for c, t in zip(cols, target, strict=True)], schema=target)

    return map_arrow(df, run, out, keep)


def to_bytes(col: pa.Array) -> list[bytes | None]:
    return col.cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def word_hashes(texts: Iterable[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and where each text's words begin (one entry more than texts).

    A null text has no words. ``lower`` folds A-Z only."""
    (hashes,), starts = seeded_hashes(texts, (0,), lower)
    return hashes, starts


def seeded_hashes(texts: Iterable[bytes | None], seeds: tuple[int, ...], lower: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """``word_hashes`` by several hash functions that have nothing to do with each other."""
    words: list[bytes] = []
    starts = [0]
    for text in texts:
        if text:
            words += (text.lower() if lower else text).split()
        starts.append(len(words))
    if not words:
        return [np.empty(0, np.uint64) for _ in seeds], np.asarray(starts, np.int64)
    coded = pa.array(words, type=pa.large_binary()).dictionary_encode()
    distinct, of = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    digest = xxhash.xxh3_64_intdigest
    return [np.fromiter((digest(w, seed) for w in distinct), np.uint64, len(distinct))[of] for seed in seeds], np.asarray(starts, np.int64)


def rolling(words: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hash of the ``k`` words from each position on, modulo 2**64, mixed; ``len(words) - k + 1`` of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.full(len(words), base, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power, dtype=np.uint64)))
        inverse = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        return mix((prefix[k:] - prefix[:n]) * inverse)


def _residues(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo ``PRIME``."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)))
    return out[:n]


def rolling_prime(words: np.ndarray, k: int) -> np.ndarray:
    """``rolling`` modulo ``PRIME``; sums of residues stay below 2**64 for fewer than 2**33 words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    prime = np.uint64(PRIME)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words % prime * _residues(BASE2, len(words)) % prime, dtype=np.uint64)))
    return mix((prefix[k:] - prefix[:n]) % prime * _residues(pow(BASE2, -1, PRIME), n) % prime)


def window_starts(starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a ``k``-word window of one text begins, and the text of each."""
    lengths = np.maximum(np.diff(starts) - k + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    return np.arange(len(owner)) - first[owner] + starts[:-1][owner], owner


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def components(edges: DataFrame, a: str = "a", b: str = "b", parts: int | None = None, limit: int | None = None) -> DataFrame:
    """Connected components: one row (node, component) for each node of an edge, the component named by its smallest node.

    Labels start as the smallest neighbour. Each round hands every node the smallest label around it and then the label of
    that label (pointer jumping), so the rounds grow with the logarithm of a path. A round is two joins and two sums of minima
    on narrow rows, written to the shared folder; only the count of changed labels reaches the driver. Labels of more than
    ``limit`` bytes are joined by shuffles, in which the edges of a hub, and the nodes that its label has reached, are dealt to
    many tasks. Nulls in ``edges`` are ignored, an empty input gives no rows. ``parts``: by how many tasks the edges are written."""
    # written first: a spanning forest may come out otherwise when it is worked out again, and both directions must agree
    both = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null"), "links", parts)
    parts = partitions_for(both, TABLE_BYTES, 1)
    both = materialise(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges", parts)
    first = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("l"), F.count("*").alias("rows")), "labels", parts)
    limit = BROADCAST_BYTES if limit is None else limit
    labels, degrees = first.select("u", "l"), first.select(F.col("u").alias("v"), "rows")
    large, former = held_bytes(labels) > limit, None
    while True:
        nearest = labels.select(F.col("u").alias("v"), "l")
        around = (spread_join(both, nearest, ["v"], limit=limit, counts=degrees) if large else both.join(nearest, "v")).groupBy("u").agg(F.min("l").alias("m"))
        nearer = labels.join(around, "u").select("u", "l", F.least("l", "m").alias("m"))
        jump = labels.select(F.col("u").alias("m"), F.col("l").alias("j"))
        joined = spread_join(materialise(nearer, "nearer", parts), jump, ["m"], "left", limit) if large else nearer.join(jump, "m", "left")
        step = materialise(joined.select("u", F.least("m", "j").alias("n"), "l"), "labels", parts)
        changed = step.where("n < l").limit(1).count()
        if former is not None:
            discard(former)
        former = step
        labels = step.select("u", F.col("n").alias("l"))
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))


#: Texts are worked on in slices of at most this many bytes (a longer text alone), so a task's memory doesn't follow its input.
SLICE_BYTES = 2 << 20
#: A side up to this many bytes in memory is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes on disk that a task writes of a narrow table.
TABLE_BYTES = 8 << 20
#: What a null id counts as where ids are ordered: it comes after every other.
NULL_ID = (1 << 63) - 1


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into runs of rows whose texts have ``most`` bytes together, or one row each."""
    col = batch.column(batch.schema.get_field_index(text))
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _width(kind: T.DataType, col):
    """What a value holds beyond its field's eight bytes."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.octet_length(col.cast("binary")).cast("long")
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
            return F.aggregate(col, F.lit(8).cast("long"), lambda total, x: total + 8 + F.coalesce(_width(inner, x), F.lit(0)))
        return 8 + F.size(col).cast("long") * (4 if isinstance(inner, T.IntegerType | T.FloatType) else 8)
    if isinstance(kind, T.StructType):
        return sum((8 + F.coalesce(_width(f.dataType, col[f.name]), F.lit(0)) for f in kind.fields), F.lit(16).cast("long"))
    return F.lit(0).cast("long")


def held_bytes(df: DataFrame) -> int:
    """What the rows of a written table take in memory: all of them counted, and their texts and arrays measured. Compression
    and estimates have no say."""
    fixed = 32 + 8 * len(df.columns)
    return df.agg(F.sum(sum((F.coalesce(_width(f.dataType, F.col(f.name)), F.lit(0)) for f in df.schema.fields), F.lit(fixed).cast("long")))).head()[0] or 0


def sized(side: DataFrame) -> DataFrame:
    """A written table, marked for broadcast up to ``BROADCAST_BYTES`` of its rows; else it is left to a shuffled join."""
    return F.broadcast(side) if held_bytes(side) <= BROADCAST_BYTES else side


#: Tasks that a hot key's rows are dealt to where the other side is too large for a broadcast, and the rows that make one hot.
SALTS, HOT_ROWS = 64, 1_000_000


def hot_keys(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Of written counts (``keys``, rows): the keys of more than ``HOT_ROWS`` rows and more than a 65536th of all rows counted, so
    that there are fewer than 65536 of them however large the input is."""
    total = counts.agg(F.sum("rows")).head()[0] or 0
    return counts.where(F.col("rows") > max(HOT_ROWS, total >> 16)).select(*keys)


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", limit: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Rows with what ``side`` (written, one row for each key) has for their key: by a broadcast, or by a shuffle if ``side`` is larger.

    In the shuffle, rows of a hot key are dealt to ``SALTS`` tasks by a hash of their other columns, and its row of ``side`` goes to
    each; all other keys move once. ``counts`` (written; ``keys`` and rows, how many rows have the key) saves counting ``rows``."""
    if held_bytes(side) <= (BROADCAST_BYTES if limit is None else limit):
        return rows.join(F.broadcast(side), keys, how)
    if counts is None:
        counts = materialise(rows.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > HOT_ROWS), "hot-keys", 1)
    many = F.broadcast(hot_keys(counts, keys).withColumn("_lamella_hot", F.lit(True)))
    others_ = [c for c in rows.columns if c not in keys]
    salt = F.when(F.col("_lamella_hot"), F.pmod(F.xxhash64(*others_), F.lit(SALTS)) if others_ else F.lit(0)).otherwise(0).cast("int")
    dealt = rows.join(many, keys, "left").withColumn("_lamella_salt", salt).drop("_lamella_hot")
    each = F.when(F.col("_lamella_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = side.join(many, keys, "left").withColumn("_lamella_salt", F.explode(each)).drop("_lamella_hot")
    return dealt.join(salted, [*keys, "_lamella_salt"], how).drop("_lamella_salt")


def guarded(docs: DataFrame, needs: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` over the columns ``needs`` of ``docs``, and the columns of ``docs`` again, whatever columns ``run`` adds or replaces."""
    rest = [c for c in docs.columns if c not in needs]
    packed = docs.select(*needs, *([F.struct(*rest).alias("_lamella_row")] if rest else []))
    return run(packed).select(*[F.col(c) if c in needs else F.col("_lamella_row")[c].alias(c) for c in docs.columns])


def text_key(text: str, id_col: str) -> list:
    """Columns that tell rows apart: the id (null: the largest) and a 64-bit hash of the text, for ids that aren't unique."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_lamella_id"), F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.xxhash64(F.col(text).cast("binary"))).cast("long").alias("_lamella_tie")]
