"""Archives that are damaged, padded or cut short: what can be read is read, and what can't has a row that says so."""

import gzip
import hashlib
import io
import random
import time

import pyarrow as pa
import pytest

from lamella.llm import common, warc


def record(n, payload=None, digest=None):
    payload = f"page {n} ".encode() * (n + 1) if payload is None else payload
    row = {"record_type": "response", "id": n, "uri": None, "digest": digest or hashlib.sha256(payload).hexdigest(), "bytes": len(payload), "payload": payload, "refers_to": None}
    return b"".join(warc.record_parts(row))


def read(raw, step=97):
    rows = list(warc.parse(warc.inflated(io.BytesIO(raw).read, step), step))
    good = [r["record_id"] for r in rows if r["last"] and not r["error"]]
    return good, [r["error"] for r in rows if r["error"]]


GOOD = [record(n) for n in range(6)]


@pytest.mark.parametrize("packed", [False, True])
def test_padding_and_line_ends(packed):
    pack = gzip.compress if packed else bytes
    for between in (b"\r\n\r\n", b"\r\n", b"\n\0\0" * 100):
        assert read(b"".join(pack(r + between) for r in GOOD)) == (list("012345"), [])
    assert read(b"".join(map(gzip.compress, GOOD)) + b"\0" * 512) == (list("012345"), [])
    assert read(b"") == ([], []) and read(b"\r\n") == ([], [])


@pytest.mark.parametrize("packed", [False, True])
def test_one_bad_record_costs_itself(packed):
    pack = gzip.compress if packed else bytes
    bad = {
        "digest": record(9, digest="0" * 64),
        "length": GOOD[2].replace(b"Content-Length: ", b"Content-Size: ", 1),
        "not a number": GOOD[2].replace(b"Content-Length: ", b"Content-Length: \xc2\xb2", 1),
        "head": b"garbage" + GOOD[2],
        "short": GOOD[2][:-20] + b"\r\n\r\n",
    }
    for name, broken in bad.items():
        good, errors = read(b"".join(map(pack, [*GOOD[:2], broken, *GOOD[3:]])))
        lost = 1 if name == "short" and not packed else 0  # a plain record that is too short takes from the next one
        assert len(errors) >= 1 and set("01") <= set(good) and len(set("345") - set(good)) <= lost, name


def test_cut_short():
    raw = b"".join(map(gzip.compress, GOOD))
    assert read(raw[:-30]) == (list("01234"), ["a gzip member ends early"])
    plain = b"".join(GOOD)
    assert read(plain[:-30]) == (list("01234"), ["a record ends early"])


def test_damaged_members():
    members = [gzip.compress(record(n, random.Random(n).randbytes(5000))) for n in range(6)]
    for at in (12, 300, len(members[2]) - 6):
        broken = bytearray(members[2])
        for k in range(4):
            broken[at + k] ^= 0xFF
        good, errors = read(b"".join([*members[:2], bytes(broken), *members[3:]]), 4096)
        assert set("01345") <= set(good) and errors
    assert read(b"".join([*members[:2], b"\x1f\x8b\x08 nothing", *members[2:]]), 512)[0] == list("012345")


def test_random_damage_never_stops_the_read():
    rng = random.Random(5)
    whole = [gzip.compress(r) for r in GOOD]
    for raw in (b"".join(whole), b"".join(GOOD)):
        for _ in range(200):
            broken = bytearray(raw)
            for _ in range(rng.randrange(1, 4)):
                broken[rng.randrange(len(broken))] = rng.randrange(256)
            good, errors = read(bytes(broken[: rng.choice([len(broken), rng.randrange(len(broken))])]), rng.choice([16, 333, 5000]))
            assert len(good) <= 6


def test_small_plain_records_are_read_in_linear_time():
    raw = b"".join(record(n, b"x" * 100) for n in range(100)) * 400
    began = time.perf_counter()
    good, errors = read(raw, 1 << 20)
    assert len(good) == 40_000 and not errors
    assert time.perf_counter() - began < 10  # copying what is held for each record takes minutes


def test_other_records_of_a_damaged_archive_are_rows(spark):
    folder = common.scratch_path(spark, "damaged")
    fs, base = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/a.warc.gz", compression=None) as out:
        out.write(b"".join(map(gzip.compress, [*GOOD[:3], GOOD[3][:-15], *GOOD[4:]])))
    manifest = spark.createDataFrame([(f"{folder}/a.warc.gz", 6, 0)], "path string, records long, bytes long")
    rows = warc.chunks(manifest).where("last").collect()
    assert sorted(r.record_id for r in rows if not r.error) == list("01245") and [r.record_id for r in rows if r.error] == ["3"]
