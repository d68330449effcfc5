"""Licence scans, importance resampling and conversation repair: brute force, odd rows, and what is longer than a part or a run."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lamella.llm import chat, common, importance, license_scan, substring_dedup, token_counts, turn_repair

from .test_edge_cases import odd  # noqa: F401

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_in(text):
    return WORD.findall((text or "").translate(LOWER))


# licences


def test_licence_words_and_places(spark):
    rng = random.Random(2)
    vocabulary = "the gnu general public license apache cc by mit nc version Ünder ﬁ İ K".split()
    texts = ["".join(rng.choice(vocabulary).title() + rng.choice([" ", ", ", "\n", "-", "\0"]) for _ in range(rng.randrange(60))) for _ in range(80)]
    texts += ["K", "mitK license", "MIT_LICENSE", "cc\x7fby", "licensed under CC BY-NC 4.0!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert len(out) == len(texts)
    for n, t in enumerate(texts):
        w = words_in(t)
        places = [(i, label) for p, label in license_scan.PHRASES.items() for k in [p.split()] for i in range(len(w)) if w[i : i + len(k)] == k]
        r, at = out[n], [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert "cc-by-nc" in out[len(texts) - 1].labels


def test_licence_templates_by_place(spark):
    t = license_scan.Template("x", "one two three four five six seven", ("four five",))
    texts = ["ONE two three, four five six seven", "one two three four and five six seven", "seven six five four three two one", "zero one two three four five six seven eight " * 3, "four five", "", None]
    docs = spark.createDataFrame([(i, s) for i, s in enumerate([*texts, *["two six"] * 9])], "doc_id long, text string")
    out = {r.doc_id: r for r in license_scan.scan(docs, templates=[t], phrases={}).collect()}
    assert [bool(out[i].labels) for i in range(7)] == [True, False, False, True, False, False, False]
    assert out[0].score == 1.0 and out[0].base_labels == "" and out[1].score == 0
    assert not any(r.labels for r in license_scan.scan(docs, templates=[]).collect())
    with pytest.raises(ValueError):
        license_scan.Template("x", "a b", ("b a",)).postings()


def test_licence_odd(odd):  # noqa: F811
    odd = odd.withColumn("LABELS", F.lit("mine")).withColumn("score", F.lit("mine"))
    out = license_scan.scan(odd)
    assert out.count() == odd.count() and "text" not in out.columns and out.columns.count("labels") == 1
    assert {(r.doc_id, r.n_words) for r in out.where("lang = 'fr'").collect()} == {(8, 2), (9, 4)}
    assert license_scan.scan(odd.limit(0)).count() == 0


# importance


def features(text):
    w = words_in(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain_resample(docs, target, buckets=10_000):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for text in texts for f in features(text)) for texts in ([x for _, x in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    out = []
    for d, text in docs:
        f = features(text)
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[of(x)] for x in f) // len(f) if f else 0
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r, (_, text) in zip(out, docs) if len(words_in(text)) >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return {tuple(r) for r in out}


def test_importance_like_plain_python(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["Ab", "c9", "é", "日本", "x", "YZ", "ẃ"]) * rng.randrange(1, 3)
    docs = [(i, "".join(word() + rng.choice(" ,\n-\x7f\0") for _ in range(rng.randrange(90)))) for i in range(60)] + [(60, None), (61, ""), (62, " ,. ")]
    target = ["".join(word() + " " for _ in range(40)) for _ in range(5)] + [None]
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(x,) for x in target], "text string")
    made = lambda: {(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in importance.resample(a, b).collect()}
    assert made() == plain_resample(docs, target)
    assert {(r.doc_id, r.n_words) for r in importance.resample(a, b, most=3).collect()} == {(d, len(words_in(t))) for d, t in docs}


@pytest.mark.parametrize("most", [1, 2, 3])
def test_texts_in_parts(most):
    rng = random.Random(most)
    for size in (1, 2, 5, 40):
        text = "".join(rng.choice("ab1é ,.") for _ in range(200))
        grams = lambda w: [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]
        got = []
        for piece, old in importance.parts(text.encode(), most, size):
            w = words_in(piece.decode())
            got += [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1) if i + k > old]
        assert sorted(got) == sorted(grams(words_in(text)))
    for w in range(30):
        assert importance.words_of(sum(max(w - k, 0) for k in range(most)), most) == w


def test_importance_of_long_texts(spark):
    rng = random.Random(4)
    docs = [(0, " ".join(f"W{rng.randrange(50)}" for _ in range(900_000))), (1, "w1 w2 " * 30), (2, "w" * 1_500_000)]
    assert len(docs[0][1]) > 3 * importance.PART_BYTES
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("w1 w2 w3",)], "text string")
    assert {(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in importance.resample(a, b).collect()} == plain_resample(docs, ["w1 w2 w3"])


def test_importance_odd(spark, odd):  # noqa: F811
    odd = odd.withColumn("RANK", F.lit("mine")).withColumn("buckets", F.lit("mine"))
    target = odd.limit(0).select("text")
    out = importance.resample(odd, target)
    rows = out.collect()
    assert len(rows) == odd.count() and "text" not in out.columns
    able = [r for r in rows if r.n_words >= 20]
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 25 * len(able) // 100 + 1))
    assert importance.resample(odd.limit(0), odd).count() == 0


# repair


def cheapest(rows):
    """(cost, audit, lines) over all edits, by search: rows are (role, text, fault)."""
    best = {}

    def go(i, state, cost, audit, lines):
        key = (i, state)
        if key in best and best[key] <= (cost, audit):
            return
        best[key] = (cost, audit)
        if i == len(rows) and state in (0, 3):
            found.append((cost, audit, lines))
        for r, name in (("u", "user"), ("a", "assistant")):
            if (state, r) in turn_repair.STEPS and audit[-4:] != "IIII":
                go(i, turn_repair.STEPS[state, r], cost + 3, audit + "I", [*lines, f"{name}:"])
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, state, cost + 4, audit + "D", lines)
            if fault in ("", "truncated"):
                more = 3 * (fault == "truncated")
                if (state, role[:1]) in turn_repair.STEPS:
                    go(i + 1, turn_repair.STEPS[state, role[:1]], cost + more, audit + "K", [*lines, f"{role}:{text}"])
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (state, r) in turn_repair.STEPS:
                        go(i + 1, turn_repair.STEPS[state, r], cost + more + 3, audit + "R", [*lines, f"{name}:{text}"])

    found = []
    go(0, 0, 0, "", [])
    return min(found)


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    seen, marked = set(), []
    for _, role, text in rows:
        tail = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    faults = Counter(f for _, _, f in marked)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    cost, audit, lines = cheapest(marked)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


CONV = "conv_id long, turn long, role string, text string, part string"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversations(rng, n, most):
    rows = []
    for c in range(n):
        for _ in range(rng.randrange(1, most)):
            role = rng.choice(["system", "user", "assistant", "assistant", "user", "tool", None, ""])
            rows.append((c if c else None, rng.choice([None, *range(6)]), role, rng.choice(["a.", "b", "c?", "", " \n", None, "d!\x0b ", "\x85", "é"]), "mine"))
    return rows


@pytest.mark.parametrize(("run", "batch"), [(64, 8192), (2, 5), (3, 1)])
def test_repair_brute_force(spark, run, batch):
    rng = random.Random(run)
    rows = conversations(rng, 40, 9)
    out = {r.conv_id: tuple(r[n] for n in NAMES) for r in turn_repair.repair(spark.createDataFrame(rows, CONV), run=run, batch=batch).collect()}
    want = {c: plain_repair([(t, r, x) for k, t, r, x, _ in rows if k == c]) for c in {r[0] for r in rows}}
    assert out == want


def test_repair_long(spark):
    """A conversation of many batches has the result that one run has."""
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["x.", f"y{i}.", f"z{i}"])) for i in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one, two = (turn_repair.repair(df, run=r, batch=b).collect() for r, b in ((1000, 1000), (7, 50)))
    assert one == two
    assert one[0].audit.count("I") + 900 == len(one[0].audit)


def test_repair_odd(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi?", "m"), (2, 0, "user", "x", "m")], CONV)
    gone = df.withColumn("gone", F.lit(True))
    out = turn_repair.repair(gone, gone="gone").collect()
    assert {tuple(r) for r in out} == {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (1, 2)}
    assert turn_repair.repair(df.limit(0)).count() == 0
    text = turn_repair.repair(df.select(F.col("conv_id").cast("string").alias("c"), F.lit(None).cast("int").alias("turn"), "role", "text"), conv="c").collect()
    assert {(r.c, r.gaps, r.audit) for r in text} == {("1", 0, "KI"), ("2", 0, "D")}


def test_damage(spark):
    rows = [(c, t, r, x) for c, t in itertools.product([*range(12), None], [*range(9), None]) for r, x in [("assistant", f"A. b{c}!? {t}")]]
    out = turn_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = Counter((r.conv_id, r.turn, r.role, r.text, r.gone) for r in out.collect())
    want = Counter()
    for c, t, r, x in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        want[(c, t, "user" if fate == 4 else r, x, fate == 0)] += 1 + (fate == 3)
    assert got == want


# what earlier operators were mended for


def test_ranges_follow_the_texts_alone(spark, tmp_path):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, " ".join(str(rng.random()) for _ in range(200))) for i in range(300)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "narrow"))
    df.select("*", *[(F.col("doc_id") * k).alias(f"c{k}") for k in range(40)], F.sha2("text", 512).alias("wide")).write.parquet(str(tmp_path / "broad"))
    narrow, broad = (spark.read.parquet(str(tmp_path / n)) for n in ("narrow", "broad"))
    size = sum(len(r.text) for r in df.collect())
    for each in (size, size // 7, 1000):
        assert common.text_partitions(narrow, "text", each, 1) == common.text_partitions(broad, "text", each, 1) == -(-size // each)
    assert common.text_partitions(df.limit(0), "text", 10) == 8
    assert common.input_bytes(broad.select("doc_id")) == common.input_bytes(broad) > common.input_bytes(narrow)
    tasks = []
    for d in (narrow, broad):
        dealt = []
        real = common.group_arrow
        substring_dedup.group_arrow = lambda g, f, s, real=real: dealt.append(s) or real(g, f, s)
        try:
            out = substring_dedup.dedup(d.select("doc_id", "text"))
        finally:
            substring_dedup.group_arrow = real
        tasks.append((len(dealt), out.count()))
    assert tasks[0] == tasks[1]


def test_exchanged_words_are_told_apart():
    """Two words 16 places apart whose hashes differ by a multiple of 2 ** 58 leave one rolling hash as it was, not both."""
    import numpy as np

    words = np.arange(1, 21, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words[16] = words[0] + np.uint64(1 << 58)
    turned = words.copy()
    turned[[0, 16]] = turned[[16, 0]]
    assert common.rolling(words, 20)[0] == common.rolling(turned, 20)[0]
    texts = [" ".join(f"w{i}" for i in range(20)).encode(), " ".join(f"w{i}" for i in [16, *range(1, 16), 0, 17, 18, 19]).encode()]
    (one, two), _ = common.seeded_hashes(texts, (0, 1))
    assert (one[0] - one[16]) != (two[0] - two[16])
    assert common.rolling(two[:20], 20, common.BASE2)[0] != common.rolling(two[20:], 20, common.BASE2)[0]


def test_chat_spans_and_pieces(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice(["é", "</s>", "", None, "a\\b[INST]", "日本"])) for c in range(20) for t in range(rng.randrange(1, 12)) for _ in range(rng.randrange(1, 3))]
    made = chat.chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in made.withColumn("said", chat.loss_text(F.col("formatted"), F.col("turn_loss"))).withColumn("pieces", chat.pieces_of(F.col("formatted"))).collect():
        assert "".join(r.pieces) == r.formatted and len(r.turn_loss) == r.n_turns == len(r.pieces)
        spans = list(zip(r.loss[::2], r.loss[1::2]))
        at, want = 0, []
        for piece, span in zip(r.pieces, r.turn_loss):
            if span is not None:
                want.append((at + span.begin, at + span.end))
            at += len(piece)
        assert spans == want and spans == sorted(spans)
        texts = [x or "" for c, t, role, x in sorted((v for v in rows if v[0] == r.conv_id), key=lambda v: (v[1], v[2] is not None, v[2] or "", len(v[3] or ""))) if role == "assistant"]
        assert sorted(r.said) == sorted("".join(texts))


def test_many_turns_take_time_in_proportion(spark):
    import time

    def took(n):
        rows = spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('text ', id) text")
        began = time.perf_counter()
        chat.chats(rows).withColumn("said", chat.loss_text(F.col("formatted"), F.col("turn_loss"))).agg(F.sum(F.length("said"))).head()
        return time.perf_counter() - began

    took(10)
    assert took(40_000) < 12  # square in the turns it was 54 s


def test_empty_batches_and_other_columns(spark):
    rollup = token_counts.Rollup(spark, common.scratch_path(spark, "rollup"))
    rows = spark.createDataFrame([("insert", "a", "en", "t", 5), ("insert", None, "en", "t", None), ("other", "a", "en", "t", 9)], "op string, source string, lang string, tokenizer string, tokens long")
    for c in ("n_docs", "N_TOKENS", "attempt", "old"):
        rows = rows.withColumn(c, F.lit(77))
    assert rollup.commit("one", rows) and rollup.commit("none", rows.limit(0)) and not rollup.commit("none", rows)
    got = {(r.source, r.lang, r.tokenizer, r.n_docs, r.n_tokens) for r in rollup.totals().collect() if r.n_docs or r.n_tokens}
    assert got == {("a", "en", "t", 1, 5), (None, "en", "t", 1, 0)}
