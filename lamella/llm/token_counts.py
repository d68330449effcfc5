"""Token counts as a delta-maintained rollup by source, language and tokenizer version.

A batch of changes is reduced to one signed delta a group: an insert adds a document and its tokens, a delete takes them away,
a revision adds the difference. The delta is written under a name of its own, and then its commit record, under a name of its
own too, is moved into view whole. Of several records of a batch the first counts, so a batch that is sent again, or by two
writers at a time, counts once; what a failed attempt left behind is in no record and is never read. Totals are sums of the
counting deltas. ``compact`` folds them into one; of two folds of the same deltas one counts. Nothing rests on a file system
that refuses to overwrite: only on a move within a folder that shows a file whole.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_schema, map_arrow, scratch_path, slices, struct, to_bytes

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens"]
_DELTA = struct("source string, lang string, tokenizer string, n_docs long, n_tokens long")


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows of ``changes``: op (insert, delete, revise), source, lang, tokenizer, tokens, and old_tokens for revisions.

    Null counts are 0; a null source, language or tokenizer is a group of its own; a row of another op changes nothing; other
    columns of ``changes`` are left out, whatever their names; without rows there are none."""
    new, old = F.coalesce("tokens", F.lit(0)), F.coalesce(F.col("old_tokens"), F.lit(0)) if "old_tokens" in changes.columns else F.lit(0)
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0).cast("long")
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).when(F.col("op") == "revise", new - old).otherwise(0).cast("long")
    return changes.select(*[F.col(k).cast("string").alias(k) for k in KEYS], docs.alias("n_docs"), tokens.alias("n_tokens"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


class Rollup:
    """A rollup kept under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        live, winners = self._live()
        return batch in winners or any(batch in r["covers"] for r in live)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False, and nothing changed, if the batch is in already. An empty batch is in afterwards, too, and
        changes nothing."""
        return not self.committed(batch) and self._publish(batch, _summed(signed(changes)), [], [])

    def _publish(self, name: str, delta: DataFrame, folds: list[str], covers: list[str]) -> bool:
        attempt = uuid.uuid4().hex
        data = f"{self.root}/data/{attempt}"
        delta.coalesce(8).write.parquet(data)
        self._record({"name": name, "attempt": attempt, "data": data, "folds": folds, "covers": covers})
        return self._live()[1][name]["attempt"] == attempt

    def _record(self, record: dict) -> None:
        folder = f"{self.root}/commits"
        hidden, shown = self._path(f"{folder}/_{record['attempt']}"), self._path(f"{folder}/{record['attempt']}.json")
        out = self._fs.create(hidden, True)
        out.write(json.dumps(record).encode())
        out.close()
        if not self._fs.rename(hidden, shown):
            raise OSError(f"commit record of {record['name']}")

    def _records(self) -> list[dict]:
        """All whole commit records, first come first; of those of one time the smallest attempt."""
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        found = []
        for status in self._fs.listStatus(folder):
            if not status.getPath().getName().endswith(".json"):
                continue
            file = self._fs.open(status.getPath())
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
            file.close()
            try:
                found.append(json.loads(text) | {"time": status.getModificationTime()})
            except ValueError:  # a store that shows a file before it is whole
                continue
        return sorted(found, key=lambda r: (r["time"], r["attempt"]))

    def _live(self) -> tuple[list[dict], dict[str, dict]]:
        """The records whose deltas count, and the record that counts of every name.

        A fold counts if all that it folds would count without it; one that comes second to another is left out."""
        winners: dict[str, dict] = {}
        for record in self._records():
            winners.setdefault(record["name"], record)
        live = {n: r for n, r in winners.items() if not r["folds"]}
        for name, record in winners.items():
            if record["folds"] and all(x in live for x in record["folds"]):
                for x in record["folds"]:
                    del live[x]
                live[name] = record
        return list(live.values()), winners

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of all published batches, without groups that have no document left."""
        live = [r["data"] for r in self._live()[0]]
        if not live:
            return self.spark.createDataFrame([], _DELTA)
        return _summed(self.spark.read.schema(_DELTA).parquet(*live)).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Fold all counting deltas into one; the names of their batches stay on record, so none can come in again."""
        live, _ = self._live()
        if len(live) < 2:
            return False
        names = sorted(r["name"] for r in live)
        covers = sorted({x for r in live for x in (r["covers"] or [r["name"]])})
        rows = self.spark.read.schema(_DELTA).parquet(*[r["data"] for r in live])
        return self._publish("fold " + hashlib.sha256("\n".join(names).encode()).hexdigest(), _summed(rows), names, covers)

    def vacuum(self) -> int:
        """Delete records and deltas that no longer count; call it while nobody writes. Returns the number of records deleted.

        What a fold stands for is named in the fold, which from then on counts alone."""
        live, _ = self._live()
        keep = {r["attempt"] for r in live}
        for record in live:
            if record["folds"]:
                self._fs.delete(self._path(f"{self.root}/commits/{record['attempt']}.json"), False)
                self._record(record | {"folds": []})
        gone = 0
        for folder in ("commits", "data"):
            path = self._path(f"{self.root}/{folder}")
            for status in self._fs.listStatus(path) if self._fs.exists(path) else []:
                name = status.getPath().getName()
                if name.removeprefix("_").removesuffix(".json") not in keep:
                    gone += folder == "commits"
                    self._fs.delete(status.getPath(), True)
        return gone


_MEASURED = struct("source string, lang string, bytes long, tokens long, words long")


def measured(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """source, lang, and the bytes, byte-level BPE tokens and white-space words of each whole text.

    A null or empty text has none but has a row; repeated rows have one each; an empty table has none; columns of ``docs``
    other than source, lang and ``text`` aren't read."""
    path = tokenizer or bpe.default_path()
    target = arrow_schema(_MEASURED)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text", bpe.SLICE_BYTES):
            texts = to_bytes(part.column(2))
            _, starts = bpe.encoder(path).encode(texts)
            sizes, words = [len(t) if t else 0 for t in texts], [len(t.split()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, type=pa.int64()), pa.array(np.diff(starts), type=pa.int64()), pa.array(words, type=pa.int64())], schema=target)

    plain = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text).alias("text"))
    return map_arrow(plain, run, _MEASURED, f"bpe {path}")


def changes(rows: DataFrame, op: str, versions: dict[str, Column], old: Column | None = None) -> DataFrame:
    """A change ``op`` for each row and tokenizer version, whose count is an expression over the row."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), c.cast("long").alias("tokens")) for v, c in versions.items()]))
    kept = [] if old is None else [old.cast("long").alias("old_tokens")]
    return rows.select(F.lit(op).alias("op"), "source", "lang", each.alias("c"), *kept).select("op", "source", "lang", "c.*", *[k for k in ("old_tokens",) if kept])


def count_tokens(docs: DataFrame, text: str = "text", tokenizer: str | None = None, version: str = "byte_bpe_50k/1", words: str = "words/1") -> DataFrame:
    """An insert for each document and tokenizer version: the byte-level BPE and white-space words, of the whole text."""
    return changes(measured(docs, text, tokenizer), "insert", {version: F.col("tokens"), words: F.col("words")})


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a corpus's usual life: documents come in with estimates, which counting revises; a version is withdrawn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang", "text")
    rollup = Rollup(spark, scratch_path(spark, "token-counts"))
    sizes = docs.select("source", "lang", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    estimate = F.floor(F.col("bytes") / 4)
    rollup.commit("estimates", changes(sizes, "insert", {"byte_bpe_50k/1": estimate, "words/1": estimate, "bytes/0": F.col("bytes")}))
    counted = changes(measured(docs), "revise", {"byte_bpe_50k/1": F.col("tokens"), "words/1": F.col("words")}, estimate)
    rollup.commit("counts", counted)
    rollup.commit("counts", counted)  # sent again: known by its record, not counted
    rollup.commit("withdrawn", changes(sizes, "delete", {"bytes/0": F.col("bytes")}))
    rollup.compact()
    return rollup.totals()
