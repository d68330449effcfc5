"""Joins in which one key has most rows, sizes of what is broadcast, window hashes: each against a plain way."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import common, ngram_join, substring_dedup, warc

from .test_edge_cases import brute_components, words


@pytest.fixture
def shuffled(monkeypatch):
    """Nothing is broadcast, and a few rows make a key hot."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(common, "HOT_ROWS", 5)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("counted", [False, True])
def test_spread_join(spark, shuffled, how, counted):
    rng = random.Random(1)
    data = [(0 if rng.random() < 0.5 else rng.randrange(20), i // 2) for i in range(400)] + [(None, 1), (None, 2)]
    rows = common.materialise(spark.createDataFrame(data, "k int, v int"), "rows")
    side = common.materialise(spark.createDataFrame([(k, f"w{k}") for k in range(0, 30, 2)], "k int, w string"), "side")
    counts = common.materialise(rows.groupBy("k").agg(F.count("*").alias("rows")), "counts") if counted else None
    got = common.spread_join(rows, side, ["k"], how, counts=counts)
    want = rows.join(side, ["k"], how)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert common.spread_join(rows.limit(0), side, ["k"], how).count() == 0
    assert common.spread_join(rows, side.limit(0), ["k"], how).count() == (len(data) if how in ("left", "left_anti") else 0)


def test_spread_join_is_even(spark, shuffled):
    """A star: one key has all rows, and no task much more than the others."""
    former = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = common.materialise(spark.range(200_000).select(F.lit(0).alias("v"), F.col("id").alias("u")), "star")
        side = common.materialise(spark.createDataFrame([(0, 7), (1, 8)], "v int, l int"), "labels")
        got = common.spread_join(rows, side, ["v"]).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for c, value in former.items():
            spark.conf.set(c, value)
    loads = sorted(r["count"] for r in got)
    assert sum(loads) == 200_000 and loads[-1] <= 3 * loads[len(loads) // 2]


def test_few_hot_keys(spark, shuffled):
    counts = spark.createDataFrame([(i, 10) for i in range(100)] + [(-1, 10_000_000)], "k int, rows long")
    assert [r.k for r in common.hot_keys(counts, ["k"]).collect()] == [-1]


def test_components_by_shuffles(spark, shuffled):
    rng = random.Random(2)
    star = [(0, i) for i in range(1, 300)]
    path = [(1000 + i, 1001 + i) for i in range(37)]
    rng.shuffle(path)
    edges = spark.createDataFrame(star + path + [(2001, 2000), (None, 4), (3000, 3000)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {i: 0 for i in range(300)} | {1000 + i: 1000 for i in range(38)} | {2000: 2000, 2001: 2000, 3000: 3000}
    assert common.components(edges.limit(0)).count() == 0


def test_ngram_join_by_shuffles(spark, shuffled, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(3)
    base = words(rng, 60, 500).split()
    docs = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(60)] = f"w{rng.randrange(50)}"
        docs.append((i, " ".join(text if i % 3 else words(rng, 30, 40).split())))
    docs += [(100 + i, docs[1][1]) for i in range(20)] + [(201, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs)


def test_revisits_by_shuffles(spark, shuffled):
    data = [(i, f"u{i}", b"x" * 200 if i % 2 else bytes([i]) * 150) for i in range(40)]
    got = {r.id: (r.record_type, r.refers_to) for r in warc.planned(spark.createDataFrame(data, "id long, uri string, payload binary")).collect()}
    assert got == {i: ("revisit", 1) if i % 2 and i > 1 else ("response", None) for i in range(40)}


def test_held_bytes(spark):
    rows = common.materialise(spark.range(10_000).select("id", F.lit("y" * 1000).alias("t"), F.array(F.lit(1), F.lit(2)).alias("a"), F.struct(F.lit("abc").alias("s"), F.lit(None).cast("string").alias("n")).alias("r"), F.array(F.lit("ab"), F.lit(None)).alias("q")), "rows")
    assert sum(map(len, rows.inputFiles())) > 0 and common.input_bytes(rows) < 2_000_000  # the files are small: all texts are equal
    assert 10_000 * 1000 < common.held_bytes(rows) < 10_000 * 1300
    assert common.held_bytes(rows.limit(0)) == 0
    assert common.held_bytes(rows.select("id").withColumn("t", F.lit(None).cast("string"))) == 10_000 * 48


def test_rolling_prime():
    rng = np.random.default_rng(4)
    for n in (0, 1, 4, 5, 6, 70):
        w = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        want = [sum(int(x) % common.PRIME * pow(common.BASE2, j, common.PRIME) for j, x in enumerate(w[i : i + 5])) % common.PRIME for i in range(n - 4)]
        assert common.rolling_prime(w, 5).tolist() == common.mix(np.asarray(want, np.uint64)).tolist()


def test_exchanged_words():
    """An exchange that leaves a sum modulo 2**64 as it was doesn't leave the sum modulo a prime."""
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 64, 20, dtype=np.uint64)
    a[18] = a[2] + np.uint64(1 << 58)
    b = a.copy()
    b[[2, 18]] = a[[18, 2]]
    assert common.rolling(a, 20) == common.rolling(b, 20) and common.rolling_prime(a, 20) != common.rolling_prime(b, 20)


def test_repeated_windows_go_no_further(spark, monkeypatch):
    """What has come together in a coarse range goes to its range once."""
    import pyarrow as pa

    texts = ["a b c d e f"] * 50
    batch = pa.RecordBatch.from_pydict({"id": list(range(50)), "text": [t.encode() for t in texts], "tie": [0] * 50})
    dealt = [b for i in range(50) for b in substring_dedup._deal(batch.slice(i, 1), 5, 1, 4)]
    rows = [r for b in substring_dedup._redeal(iter(dealt), 4) for r in b.to_pylist()]
    assert sum(len(r["hash"]) // 8 for r in rows if r["hash"]) == 2
    found = {(int(np.frombuffer(r["ids"], np.int64)[0]), p) for r in rows if not r["hash"] for p in np.frombuffer(r["counts"], "<i4").tolist()}
    assert found == {(i, p) for i in range(1, 50) for p in (0, 1)}
