"""WARC archives as a chunked record table.

Writing: each task streams its records into archives of bounded size, one gzip member a record, in the shared folder. Of
equal payloads of at least ``MIN_REVISIT`` bytes one is a response record and the others are revisits of it. Only archives
named in the written manifest count, so what a lost task left behind is never read.

Archives of other writers are read too: any record type, any of the usual digests, header names in any case.

Reading: an archive is inflated and parsed as a stream, over what is damaged in it. A payload comes out as rows of (record id, chunk number) with at most
``CHUNK`` bytes each, carrying the digest and length of the payload up to there; no record is ever held whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, materialise, released, scratch_path, spread_join, struct

MIN_REVISIT, CHUNK, ROLL = 100, 1 << 20, 256 << 20
#: Bytes that a head of a record or of its HTTP message may have.
HEAD = 1 << 20
_GZIP = b"\x1f\x8b\x08"
MANIFEST = struct("path string, records long, bytes long")
CHUNKS = struct("record_id string, chunk_no long, record_type string, refers_to string, uri string, payload_bytes long, payload_digest string, bytes_so_far long, digest_so_far string, last boolean, error string, data binary")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def planned(records: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """``records`` (id, uri, payload) with digest, bytes, record_type and refers_to.

    Of payloads that are equal (same SHA-256) and have ``least`` bytes or more, the smallest id is the response; rows that repeat
    that id are responses too. A null payload is empty, one of any length is hashed whole. A null id revisits an equal payload
    that has an id; null ids among themselves are all responses. An empty table gives no rows; columns other than the three
    are left out. Where the list of equal payloads is too large for a broadcast, payloads move once, those of a hot digest
    spread over many tasks."""
    made = records.withColumn("payload", F.coalesce("payload", F.lit(b""))).withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    owners = made.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("owner"), F.count("*").alias("c")).where("c > 1 and owner is not null")
    owners = materialise(owners, "equal")
    joined = spread_join(made.select("id", "uri", "payload", "digest", "bytes"), owners.select("digest", "owner"), ["digest"], "left", counts=owners.select("digest", F.col("c").alias("rows")))
    revisit = F.col("owner").isNotNull() & (F.col("bytes") >= least) & ~F.col("id").eqNullSafe(F.col("owner"))
    return joined.select("id", "uri", "payload", "digest", "bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("owner")).alias("refers_to"))


def record_head(row: dict, block: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{'' if row['id'] is None else row['id']}>", f"WARC-Date: {_DATE}"]
    if row["uri"] is not None:
        lines.append("WARC-Target-URI: " + quote(row["uri"], safe="".join(map(chr, range(33, 127))).replace("%", "") + "%"))
    lines += [f"WARC-Payload-Digest: sha256:{row['digest']}", f"X-Payload-Length: {row['bytes']}"]
    if row["record_type"] == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def record_parts(row: dict) -> Iterator[bytes]:
    """A record's bytes, piece by piece."""
    http = _HTTP % row["bytes"]
    whole = row["record_type"] == "response"
    yield record_head(row, len(http) + (row["bytes"] if whole else 0)) + http
    if whole:
        view = memoryview(row["payload"])
        for at in range(0, len(view), CHUNK):
            yield view[at : at + CHUNK]
    yield b"\r\n\r\n"


def write(records: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Write planned ``records`` below ``folder`` and return the manifest: path, records, bytes of each committed archive."""
    schema = arrow_schema(MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        stem, done, out, n, size = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", [], None, 0, 0

        def close() -> None:
            nonlocal out, n, size
            if out is not None:
                out.close()
                done.append({"path": f"{folder}/{stem}-{len(done)}.warc.gz", "records": n, "bytes": size})
                out, n, size = None, 0, 0

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if out is None:
                    out = fs.open_output_stream(f"{base}/{stem}-{len(done)}.warc.gz", compression=None)
                member = zlib.compressobj(4, wbits=31)
                for part in record_parts(row):
                    size += out.write(member.compress(part)) or 0
                size += out.write(member.flush()) or 0
                n += 1
                if out.tell() >= roll:
                    close()
        close()
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    return materialise(records.mapInArrow(run, MANIFEST), "manifest")


class Broken(ValueError):
    """What makes a record unreadable; its text goes to the record's row."""


class _Mark:
    """In a stream of pieces: a gzip member begins here (no reason), or cannot be read from here on."""

    def __init__(self, reason: str | None = None):
        self.reason = reason


def inflated(read, step: int = CHUNK) -> Iterator[bytes | _Mark]:
    """The bytes of a plain or gzip stream, at most ``step`` at a time, with a mark where a member begins or is damaged.

    After damage the stream goes on at the next place that looks like a member; padding between members is skipped."""
    raw = read(step)
    if raw[:2] != _GZIP[:2]:
        while raw:
            yield raw
            raw = read(step)
        return
    while raw:
        yield _Mark()
        member = zlib.decompressobj(wbits=31)
        while not member.eof:
            if not raw and not (raw := read(step)):
                yield _Mark("a gzip member ends early")
                return
            try:
                out = member.decompress(raw, step)
            except zlib.error as why:
                yield _Mark(f"a gzip member is damaged: {why}")
                raw = _sought(raw[1:], read, step)
                break
            if out:
                yield out
            raw = member.unused_data if member.eof else member.unconsumed_tail
        else:
            raw = raw or read(step)
            if raw[:2] != _GZIP[:2]:
                raw = _sought(raw, read, step)


def _sought(raw: bytes, read, step: int) -> bytes:
    """The stream from the next place on that begins like a gzip member; empty at the end."""
    while (at := raw.find(_GZIP)) < 0:
        more = read(step)
        if not more:
            return b""
        raw = raw[-2:] + more
    return raw[at:]


class _Source:
    """A stream of pieces that is read forward; what has been read is only passed over, and dropped when more is fetched."""

    def __init__(self, pieces: Iterator[bytes | _Mark]):
        self.pieces, self.held, self.at, self.dropped = pieces, b"", 0, 0
        self.members: deque[int] = deque()  # where members begin that haven't been reached, counted from the stream's begin
        self.packed = self.records = 0

    def more(self) -> bool:
        for piece in self.pieces:
            if isinstance(piece, _Mark):
                if piece.reason:
                    raise Broken(piece.reason)
                self.members.append(self.dropped + len(self.held))
                self.packed += 1
                continue
            self.dropped += self.at
            self.held, self.at = self.held[self.at :] + piece, 0
            return True
        return False

    def has(self, n: int) -> bool:
        """Whether ``n`` bytes are left; they are held then."""
        while len(self.held) - self.at < n:
            if not self.more():
                return False
        return True

    def record(self) -> bool:
        """Goes to the next record, over line ends and padding; false at the end."""
        while True:
            rest = len(self.held) - self.at
            stripped = self.held[self.at : self.at + 64].lstrip(b"\r\n\0")
            if stripped:
                self.at += min(rest, 64) - len(stripped)
                break
            self.at += min(rest, 64)
            if self.at == len(self.held) and not self.more():
                return False
        self.records += 1
        while self.members and self.members[0] <= self.dropped + self.at:
            self.members.popleft()
        if not self.begins():
            raise Broken("no record begins here")
        return True

    def begins(self) -> bool:
        return self.has(5) and self.held[self.at : self.at + 5] == b"WARC/"

    def edge(self) -> int:
        """Where in what is held the next member begins, or the end. One that begins with a record ends the record before it."""
        while self.members and self.members[0] == self.dropped + self.at:
            if self.begins():
                raise Broken("a record ends early")
            self.members.popleft()
        return min(self.members[0] - self.dropped, len(self.held)) if self.members else len(self.held)

    def until(self, mark: bytes, most: int) -> bytes:
        """The bytes before ``mark``, over which the source goes; ``most`` is what a head may take."""
        while (found := self.held.find(mark, self.at)) < 0:
            if len(self.held) - self.at > most:
                raise Broken("a head has no end")
            if not self.more():
                raise Broken("a record ends early")
        out = b"".join(self.take(found - self.at, most))
        self.at += len(mark)
        return out

    def take(self, n: int, step: int) -> Iterator[bytes]:
        while n:
            if self.at == len(self.held) and not self.more():
                raise Broken("a record ends early")
            out = self.held[self.at : min(self.at + min(n, step), self.edge())]
            self.at += len(out)
            n -= len(out)
            if out:
                yield out

    def resume(self) -> bool:
        """After a broken record, goes to where the next may begin: at the next gzip member, where each record is one, else at the
        next line like a record's first. False if there is none."""
        while True:
            try:
                here = self.dropped + self.at
                while self.members and self.members[0] < here:
                    self.members.popleft()
                if self.packed and self.packed >= self.records:
                    if self.members:
                        self.at = self.members.popleft() - self.dropped
                        if self.begins():
                            return True
                        continue
                    self.at = len(self.held)
                elif (found := self.held.find(b"\nWARC/", self.at)) >= 0:
                    self.at = found + 1
                    return True
                else:
                    self.at = max(self.at, len(self.held) - 5)
                if not self.more():
                    return False
            except Broken:
                pass


def _headers(block: bytes) -> dict[str, str]:
    """Header lines after the first, names in lower case; a line that begins with a blank goes on with the one before."""
    out: dict[str, str] = {}
    name = None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _checked(declared: str):
    """The hash that a declared digest (``algorithm:value``, hexadecimal or base 32) is of, and the value as bytes; (None, None) if unknown."""
    kind, _, value = declared.partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("sha1", "sha256", "sha512", "md5"):
        return None, None
    made = hashlib.new(kind)
    try:
        raw = bytes.fromhex(value) if len(value) == 2 * made.digest_size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return None, None
    return (made, raw) if len(raw) == made.digest_size else (None, None)


def _own(name: str | None) -> str | None:
    """A record's name without its brackets, and without the prefix that ``record_head`` gives."""
    return name.removeprefix("<").removesuffix(">").removeprefix("urn:page:") if name else None


def parse(pieces: Iterator[bytes | _Mark], step: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of all records in a stream; a record without payload has one row.

    The payload is what follows the HTTP head, where the record holds an HTTP message, else the whole block. Its declared
    length (revisits of this module's archives) and digest are passed on, the digest as written without its algorithm.

    A record that cannot be read ends with a row that says why in ``error`` (without a name where its head is broken), and the
    next one that can be found is read. So does one whose payload isn't what a declared digest of a known kind is of, unless it
    was sent in a transfer coding. Line ends and padding between records are passed over. An empty stream has no rows."""
    source = _Source(pieces)
    while True:
        state: dict = dict.fromkeys(("record_id", "record_type", "refers_to", "uri", "payload_bytes", "payload_digest"))
        state |= {"chunk_no": 0, "bytes_so_far": 0, "digest_so_far": hashlib.sha256().hexdigest(), "error": None}
        try:
            if not source.record():
                return
            yield from _record(source, state, step)
        except Broken as why:
            yield state | {"error": str(why), "last": True, "data": b""}
            if not source.resume():
                return


def _record(source: _Source, state: dict, step: int) -> Iterator[dict]:
    head = _headers(source.until(b"\r\n\r\n", HEAD))
    kind, declared = head.get("warc-type"), head.get("warc-payload-digest", "")
    state |= {"record_id": _own(head.get("warc-record-id")), "record_type": kind, "refers_to": _own(head.get("warc-refers-to")), "uri": head.get("warc-target-uri"), "payload_digest": declared.partition(":")[2] or None}
    if not (length := head.get("content-length", "")).isascii() or not length.isdigit():
        raise Broken("a record has no length")
    left, http = int(length), b""
    if head.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        source.has(min(left, HEAD))
        end = source.held.find(b"\r\n\r\n", source.at, source.at + left)
        if end < 0 and left > HEAD:
            raise Broken("a head has no end")
        size = left if end < 0 else end + 4 - source.at
        http = b"".join(source.take(size, HEAD))
        left -= size
    digest = hashlib.sha256()
    other, wanted = _checked(declared) if kind != "revisit" and "transfer-encoding" not in _headers(http) else (None, None)
    known = head.get("x-payload-length", "")
    state["payload_bytes"] = int(known) if known.isascii() and known.isdigit() else left if kind != "revisit" else None

    def row(data: bytes, last: bool) -> dict:
        wrong = last and other and other.digest() != wanted
        return state | {"last": last, "data": data, "error": "the payload isn't what its digest is of" if wrong else None}

    if not left:
        yield row(b"", True)
    for data in source.take(left, step):
        digest.update(data)
        if other:
            other.update(data)
        left -= len(data)
        state |= {"bytes_so_far": state["bytes_so_far"] + len(data), "digest_so_far": digest.hexdigest()}
        yield row(data, not left)
        state["chunk_no"] += 1


def chunks(manifest: DataFrame, step: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunk table of a manifest's archives; without ``data`` the bytes are read and digested but not passed on. Records that
    cannot be read have rows with an ``error``; those around them are read."""
    schema = arrow_schema(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(inner, compression=None) as file:
                    rows, held = [], 0
                    for row in parse(inflated(file.read, step), step):
                        held += len(row["data"]) if data else 0
                        rows.append(row if data else row | {"data": None})
                        if held >= 8 * step or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                released()

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(run, CHUNKS)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = pages.select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload"))
    table = chunks(write(planned(records), scratch_path(spark, "archives")), data=False).where("last")
    full = F.when(F.col("record_type") == "response", F.col("digest_so_far")).otherwise(F.col("payload_digest"))
    size = F.when(F.col("record_type") == "response", F.col("bytes_so_far")).otherwise(F.col("payload_bytes"))
    whole = F.nullif("record_id", F.lit("")).cast("long")
    return table.select(whole.alias("page_id"), size.alias("payload_bytes"), full.alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS owner FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> owner THEN owner END AS refers_to FROM m
"""
