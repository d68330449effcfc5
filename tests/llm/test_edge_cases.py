"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and brute force on small inputs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import bpe, chat, common, decontaminate, html_extract, ngram_join, packing, quality, substring_dedup, token_counts, url_filter, warc
from lamella.llm.bpe import Encoder, default_path
from lamella.llm.html_blocks import features, leaf_blocks
from lamella.llm.labelled_pages import labelled_page

from ..conftest import SMALL

DOC = "doc_id long, text string, lang string, source string"


def words(rng, n, vocabulary=30):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture
def odd(spark):
    """Documents that no operator may stumble over, with columns named like results."""
    rng = random.Random(0)
    base = words(rng, 60, 1000)
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", None),
        (3, " \n\t ", None, "a"),
        (4, base, "en", "a"),
        (4, base, "en", "a"),
        (5, base + " tail", "en", "a"),
        (None, base, "en", "a"),
        (6, words(rng, 50_000, 10**6), "de", "b"),
        (6, "same id other text", "de", "b"),
        (7, "a b", None, None),
        (8, "a b", "fr", "c"),
        (9, "Ünïcödé\x85\xa0 \u2028 words 日本", "fr", "c"),
    ]
    df = spark.createDataFrame(rows, DOC)
    for c in ("n_words", "n_hit", "kept", "distance", "items", "kept_text", "tokens", "part", "place", "start", "host", "n", "N_REMOVED", "centre", "cuts", "_id", "Spans", "ids"):
        df = df.withColumn(c, F.lit("mine"))
    return df


def test_decontaminate(spark, odd):
    bench = spark.createDataFrame([(1, "A, b!"), (2, None), (3, ""), (None, "same id other text"), (1, "tail")], "item_id int, text string")
    out = {(r.doc_id, r.text): r for r in decontaminate.scan(odd, bench).collect()}
    assert out[(7, "a b")]["items"] == ["1"] and out[(7, "a b")].n_hit == 2
    assert out[(6, "same id other text")].n_hit == 4 and out[(6, "same id other text")]["items"] == []
    assert out[(1, None)].n_words == 0 and out[(2, "")].n_hit == 0
    assert decontaminate.scan(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.scan(odd.limit(0), bench).count() == 0


def test_decontaminate_in_passes_and_spans(spark):
    rng = random.Random(1)
    texts = [words(rng, rng.randrange(40), 4) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(f"<é>{t.upper()}!" for t in texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, words(rng, rng.randrange(1, 8), 4)) for i in range(12)], "item_id int, text string")
    one = decontaminate.scan(docs, bench, window=3).orderBy("doc_id").collect()
    assert one == decontaminate.scan(docs, bench, window=3, max_windows=5).orderBy("doc_id").collect()
    items = [r.text.split() for r in bench.collect()]
    for r in one:
        w = [x for x in ["é", *texts[r.doc_id].split()]]
        hit = set()
        for item in items:
            n = min(3, len(item))
            for j in range(len(item) - n + 1):
                hit |= {i + k for i in range(len(w) - n + 1) if w[i : i + n] == item[j : j + n] for k in range(n)}
        assert (r.n_words, r.n_hit) == (len(w), len(hit))
        assert sum(len(r.text[s.begin : s.end].split()) for s in r.spans) == len(hit)


def brute_removal(docs, window):
    first, gone = {}, {d: set() for d, _ in docs}
    for d, t in sorted(docs):
        w = t.split()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if first.setdefault(key, (d, i)) != (d, i):
                gone[d] |= set(range(i, i + window))
    return gone


@pytest.mark.parametrize(("seed", "coarse"), [(0, 8192), (1, 8192), (2, 3)])
def test_substring_dedup_brute_force(spark, seed, coarse, monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 500)
    monkeypatch.setattr(substring_dedup, "COARSE", coarse)  # 3: ranges within coarse ranges
    monkeypatch.setattr(substring_dedup, "HELD", 100)
    rng = random.Random(seed)
    docs = [(i, "  ".join(words(rng, rng.randrange(1, 30), 3).split()) + "\n") for i in range(80)]
    out = substring_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), window=5).collect()
    gone = brute_removal(docs, 5)
    for r in out:
        w = dict(docs)[r.doc_id].split()
        kept = [x for i, x in enumerate(w) if i not in gone[r.doc_id]]
        assert r.kept_text.split() == kept and r.n_removed == len(gone[r.doc_id])
        assert r.kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()


def test_substring_dedup_odd(odd):
    out = substring_dedup.dedup(odd).collect()
    assert len(out) == odd.count()
    by = {(r.doc_id, r.text): r for r in out}
    base = by[(4, by[(4, [k for k in by if k[0] == 4][0][1])].text)]
    assert base.n_removed == 0 and [r for r in out if r.doc_id == 5][0].n_removed == 60
    assert [r for r in out if r.doc_id is None][0].n_removed == 60
    assert by[(1, None)].kept_text is None and by[(1, None)].n_words == 0
    assert substring_dedup.dedup(odd.limit(0)).count() == 0


def brute_components(docs, k=3, share=0.9):
    sets = {}
    for d, t in docs:
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()
    comp = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]) - 1e-12:
                x, y = comp[a], comp[b]
                comp = {d: min(x, y) if c in (x, y) else c for d, c in comp.items()}
    return {d: (len(sets[d]), comp[d]) for d in sets}


@pytest.mark.parametrize("block", [4, 1024])
def test_ngram_join_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(7)
    docs = []
    for g in range(12):
        base = words(rng, rng.randrange(1, 120), 500).split()
        for _ in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            docs.append((len(docs) * 3 % 101, " ".join(w)))
    docs = list(dict(docs).items())
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    assert got == brute_components(docs)
    assert sorted(r.doc_id for r in ngram_join.dedup(df).collect()) == sorted({c for _, c in got.values()})
    edges, members = ngram_join.pairs(df)
    sig = {r.sig: r.id for r in members.collect()}
    texts = dict(docs)
    found = {tuple(sorted((r.a, r.b))) for r in edges.collect()}
    sets = {s: set(ngram_join.shingle_sets([texts[i].encode()], 3)[0].tolist()) for s, i in sig.items()}
    want = {tuple(sorted((a, b))) for a in sets for b in sets if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b])}
    assert found == want


def test_ngram_join_odd(odd):
    out = ngram_join.join(odd).collect()
    assert len(out) == odd.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)]
    assert {c for _, c in by[4]} == {4} and by[5][0][1] == 4 and by[None][0][1] == 4
    assert by[8] == [(1, 7)]
    kept = ngram_join.dedup(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 1 and kept.where("doc_id is null").count() == 0
    assert ngram_join.join(odd.limit(0)).count() == 0


def test_pipeline_joins_near_copies_of_five_words(spark):
    import corpus_pipeline

    rng = random.Random(11)
    docs = [(0, words(rng, 200, 10**6))]
    docs.append((1, " ".join(f"x{i}" if i in (30, 80, 120, 170) else w for i, w in enumerate(docs[0][1].split()))))  # 0.886 by three words, 0.815 by five
    for _ in range(15):
        base = words(rng, rng.randrange(1, 200), 500).split()
        for changes in (0, 2, 4, 6):
            w = list(base)
            for _ in range(changes):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            docs.append((len(docs), " ".join(w)))
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(4), "").collect()}
    want = {c for _, c in brute_components(docs, 5, 0.8).values()}
    assert 1 not in want and want != {c for _, c in brute_components(docs).values()}
    assert kept == want


def test_pipeline_odd(spark, odd):
    """Nulls, repeated rows, clashing columns and empty tables through every stage."""
    import corpus_pipeline

    docs = odd.withColumn("n_chars", F.length("text").cast("int"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        assert {r.kept for r in out.collect()} <= {"mine"} and {r.N_REMOVED for r in out.collect()} <= {"mine"}
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    passages = corpus_pipeline.repeated_passages(spark, docs, SMALL).collect()
    assert len(passages) == docs.count() and all(r.n_chars == (None if r.text is None else len(r.text)) for r in passages)
    assert corpus_pipeline.sequences(spark, docs, SMALL).where("start = 0").count() == docs.count()


def brute_pipeline(spark, docs):
    """What the substring and leak stages must leave of ``docs`` (rows), in plain Python."""
    import pyarrow.parquet as pq

    gone = brute_removal([(r.doc_id, r.text) for r in docs], 20)
    cut = {r.doc_id: [w for i, w in enumerate(r.text.split()) if i not in gone[r.doc_id]] for r in docs}
    items = [w for t in pq.read_table(f"{SMALL}/benchmark.parquet").column("text").to_pylist() if (w := decontaminate.words_of((t or "").encode()))]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in items for i in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(w) for w in windows}

    def clean(words):
        w = decontaminate.words_of(" ".join(words).encode())
        return not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    return cut, {d: w for d, w in cut.items() if clean(w)}


def test_pipeline_like_plain_python(spark):
    """The last three stages over what the first two keep of a whole table."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = common.materialise(p.near_copies(spark, p.quality_rules(spark, docs, SMALL), SMALL), "kept")
    cut, clean = brute_pipeline(spark, kept.collect())
    passages = common.materialise(p.repeated_passages(spark, kept, SMALL), "passages")
    assert {r.doc_id: r.text.split() for r in passages.collect()} == cut
    rest = common.materialise(p.benchmark_leaks(spark, passages, SMALL), "rest")
    assert {r.doc_id: r.text.split() for r in rest.collect()} == clean and clean.keys() != cut.keys()
    e = Encoder(default_path())
    pieces = p.sequences(spark, rest, SMALL).orderBy("sequence_id", "offset").collect()
    stream = [i for r in pieces for i in r.ids]
    assert [(r.sequence_id * 2048 + r.offset) for r in pieces] == np.concatenate(([0], np.cumsum([r.length for r in pieces])[:-1])).tolist()
    ids = {}
    for r in sorted(pieces, key=lambda r: r.start):
        ids.setdefault(r.doc_id, []).extend(r.ids)
    texts = {r.doc_id: r.text for r in rest.collect()}
    assert ids == {d: [*e.tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()} and len(stream) == sum(map(len, ids.values()))


def test_boilerplate_makes_few_pairs(spark):
    """One passage in many otherwise different documents: no pair of them is listed, the near copies among them are."""
    rng = random.Random(4)
    common_words = words(rng, 12, 10**6)
    docs = [(i, words(rng, 150, 10**6) + " " + common_words) for i in range(3000)]
    docs += [(3000 + i, docs[i][1] + " end") for i in range(50)]
    members, found = ngram_join.classes(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 3, (9, 10))
    assert found.count() == 100
    assert ngram_join.links(found, (9, 10), every=True).count() == 50


def test_rows_of_one_id_are_told_apart_by_text(spark):
    rng = random.Random(2)
    texts = [words(rng, 25, 10**6) for _ in range(40)]
    docs = spark.createDataFrame([(None, t) for t in texts + texts[:5]], "doc_id long, text string")
    assert ngram_join.dedup(docs).count() == 40
    assert substring_dedup.dedup(docs).where("n_removed > 0").count() == 0
    key = docs.select(common.text_key("text", "doc_id")[1]).distinct().count()
    assert key == 40


def test_components_of_a_path(spark):
    n = 40
    ids = list(range(n))
    random.Random(0).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(100, 101), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {100: 100, 101: 100}


def test_quality_odd(spark, odd):
    out = quality.judge(odd)
    assert out.count() == odd.count()
    assert not [r for r in out.where("doc_id in (1, 2, 3)").collect() if r.kept or not r.base_failed]
    assert quality.judge(odd.limit(0)).count() == 0


def test_mcd_is_the_exact_one(spark):
    """Of small groups with some rows far off: the subset of the least determinant among all, by enumeration."""
    from itertools import combinations

    rng = np.random.default_rng(0)
    groups = {}
    for g in range(6):
        x = rng.normal(size=(12, 4)) * [0.05, 0.02, 0.03, 0.04] + [1.6, 0.4, 0.1, 1.3]
        x[:3] += rng.choice([-1, 1], (3, 4)) * [0.6, 0.4, 0.5, 0.5]
        groups[f"s{g}"] = x
    rows = [("en", s, r.tolist()) for s, x in groups.items() for r in x]
    made = common.materialise(spark.createDataFrame(rows, "lang string, source string, x array<double>"), "x")
    got = {r.source: r for r in quality.estimates(made).where("level = 0").collect()}
    for s, x in groups.items():
        best = min(combinations(range(12), 9), key=lambda c: np.linalg.slogdet(np.cov(x[list(c)].T, bias=True))[1])
        assert got[s].rows == 12 and np.allclose(got[s].centre, x[list(best)].mean(0))
        assert np.allclose(np.reshape(got[s].scatter, (4, 4)), np.cov(x[list(best)].T, bias=True) + quality.RIDGE * np.eye(4))


def plain_mcd(x):
    """Concentration steps over one group in numpy, with the same distance bins and starts."""
    best = None
    for start in range(2):
        if start == 0:
            centre = np.array([np.median(np.round(c, 4)) for c in x.T])
            mad = np.array([np.median(np.round(abs(c - m), 4)) for c, m in zip(x.T, centre, strict=True)])
            inverse = np.diag(1 / ((mad * 1.4826) ** 2 + quality.RIDGE))
        else:
            centre, inverse = x.mean(0), np.linalg.inv(np.cov(x.T, bias=True).reshape(4, 4) + quality.RIDGE * np.eye(4))
        now = (np.inf, centre, None)
        while True:
            d = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
            bins = np.floor(np.log2(np.maximum(d, 0) + 1e-6) * 64)
            edge = np.sort(bins)[int(np.ceil(quality.SUBSET * len(x))) - 1]
            core = x[bins <= edge]
            scatter = np.cov(core.T, bias=True).reshape(4, 4) + quality.RIDGE * np.eye(4)
            logdet = np.linalg.slogdet(scatter)[1]
            if not logdet < now[0] - quality.TOLERANCE:
                break
            now = (logdet, core.mean(0), scatter)
            centre, inverse = core.mean(0), np.linalg.inv(scatter)
        if best is None or now[0] < best[0]:
            best = now
    return len(x), (best[1], best[2] * quality.consistency(quality.SUBSET, 4))


def test_quality_like_numpy(spark):
    """Every verdict and distance over a whole table, against estimates that numpy makes group by group."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = quality.judge(docs).select("*", F.array(*quality.vector()).alias("x")).collect()
    passed = [r for r in out if not r.base_failed]
    of = lambda *keys: plain_mcd(np.array([r.x for r in passed if tuple(r[k] for k, _ in keys) == tuple(v for _, v in keys)]))
    whole = of()
    limit = quality.chi2_quantile(1 - quality.ALPHA, 4)
    cache = {}
    for r in out:
        assert r.kept == (not r.base_failed and r.distance <= limit)
        if r.base_failed:
            continue
        key = r.lang, r.source
        if key not in cache:
            wider = quality._mixed(*of(("lang", r.lang)), whole[1], quality.PRIOR)
            cache[key] = quality._mixed(*of(("lang", r.lang), ("source", r.source)), wider, quality.PRIOR)
        centre, scatter = cache[key]
        off = np.array(r.x) - centre
        assert r.distance == pytest.approx(off @ np.linalg.solve(scatter, off), rel=1e-4)


def test_what_keeps_a_scatter_regular_decides_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = quality.counted(docs).where(~quality.base_failed())
    rows = common.materialise(plain.select("lang", "source", F.array(*quality.vector()).alias("x")), "x")
    own = [np.diag(np.reshape(r.scatter, (4, 4))) for r in quality.estimates(rows).where("level < 2 and rows >= 8").collect()]
    assert len(own) > 20 and np.mean(np.array(own) > 10 * quality.RIDGE) > 0.95


def test_chi_square():
    assert quality.chi2_quantile(0.95, 4) == pytest.approx(9.487729)
    assert quality.chi2_quantile(0.999, 1) == pytest.approx(10.827566)


def test_encoder_is_exact():
    e = Encoder(default_path())
    rng = random.Random(5)
    parts = ["don't", "'s", "'tis", " 't", "we'll", "I'VE", "''s", " ", "  ", "\n", "\t", " \n ", "\x85", "é", "ß", "12", "½", "a1b2", "...", "<|endoftext|>", "日本", "😀", "\r\n", "\x1c", "_", "' s", "word", "x'"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    ids, starts = e.encode([t.encode() for t in texts] + [None, b""])
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)] + [[], []]
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == want
    e.known = dict.fromkeys(map(str, range(10**6)), 0)  # forces a fresh start
    assert e.encode([b"again and again"])[0].tolist() == e.tokenizer.encode("again and again").ids


def test_encoder_with_more_pre_tokens_than_it_remembers(monkeypatch):
    monkeypatch.setattr(bpe, "_KNOWN_MOST", 100)
    e = Encoder(default_path())
    many = " ".join(f"{i} id{i * 7919}" for i in range(300))
    for texts in (["a text before"], [many], ["a text after", many + " more"], ["a text before"]):
        ids, starts = e.encode([t.encode() for t in texts])
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == want


def test_packing_odd(odd):
    out = packing.pack(odd, length=16).toPandas()
    assert out.groupby(["sequence_id"]).length.sum().iloc[:-1].eq(16).all()
    assert (out.length == out.ids.map(len)).all()
    assert (out[out.doc_id == 1].doc_tokens == 1).all() and len(out[out.doc_id == 1]) == 1
    assert packing.pack(odd.limit(0)).count() == 0


@pytest.fixture
def rollup(spark):
    schema = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    r = token_counts.Rollup(spark, common.scratch_path(spark, "rollup"))
    r.rows = lambda *x: spark.createDataFrame(list(x), schema)
    r.read = lambda: {(x.source, x.n_docs, x.n_tokens) for x in r.totals().collect()}
    return r


def test_rollup(rollup):
    r = rollup
    assert r.totals().count() == 0
    first = r.rows(("insert", "a", "en", "t", 10, None), ("insert", "a", "en", "t", 5, None), ("insert", None, "en", "t", None, None), ("insert", "b", "en", "t", 3, None))
    assert r.commit("one/1", first) and not r.commit("one/1", first)
    assert r.commit("two", r.rows(("revise", "a", "en", "t", 12, 10), ("delete", "b", "en", "t", 3, None), ("other", "a", "en", "t", 99, None)))
    want = {("a", 2, 17), (None, 1, 0)}
    assert r.read() == want
    assert r.compact() and r.read() == want and not r.compact()
    assert not r.commit("two", first) and r.read() == want
    assert r.commit("three", first.limit(0)) and r.read() == want
    assert not r._publish("three", token_counts._summed(token_counts.signed(first)), [], []) and r.read() == want
    assert r.compact() and r.vacuum() > 0 and r.read() == want and len(r._records()) == 1
    assert not r.commit("one/1", first) and not r.commit("three", first) and r.read() == want


def test_rollup_survives_a_writer_that_dies(rollup):
    """A record that was begun, or cut short, is no commit: the batch can come again."""
    r = rollup
    batch = r.rows(("insert", "a", "en", "t", 15, None))
    record = r._record
    r._record = lambda record: None  # dies before the record is shown
    with pytest.raises(KeyError):
        r.commit("one", batch)
    r._record = record
    out = r._fs.create(r._path(f"{r.root}/commits/cut.json"), True)
    out.write(b'{"name": "one", "att')
    out.close()
    r._fs.create(r._path(f"{r.root}/commits/empty.json"), True).close()
    assert not r.committed("one") and r.read() == set()
    assert r.commit("one", batch) and r.read() == {("a", 1, 15)}


def test_rollup_of_compactions_at_one_time(spark, rollup):
    """Two compactions that saw the same deltas, and one that saw a later batch too: every delta counts once."""
    r = rollup
    for i in range(3):
        r.commit(f"batch {i}", r.rows(("insert", "a", "en", "t", 5, None)))
    others = [token_counts.Rollup(spark, r.root) for _ in range(2)]
    seen = r._live()
    for x in others:
        x._live = lambda seen=seen: seen
        with pytest.raises(KeyError):
            x.compact()  # publishes; its view is too old to find its own record
    assert r.read() == {("a", 3, 15)}
    r.commit("batch 3", r.rows(("insert", "a", "en", "t", 5, None)))
    wide, narrow = r._live(), (r._live()[0][:1], {})
    r._publish("fold wide", token_counts._summed(token_counts.signed(r.rows(("insert", "a", "en", "t", 20, None)))).withColumn("n_docs", F.lit(4).cast("long")), [x["name"] for x in wide[0]], [])
    assert r.read() == {("a", 4, 20)}
    r._publish("fold narrow", token_counts._summed(token_counts.signed(r.rows(("insert", "a", "en", "t", 15, None)))), [x["name"] for x in narrow[0]], [])
    assert r.read() == {("a", 4, 20)}
    r.vacuum()
    assert r.read() == {("a", 4, 20)}


def test_token_counts_odd(odd):
    out = token_counts._summed(token_counts.signed(token_counts.count_tokens(odd))).collect()
    assert sum(r.n_docs for r in out) == 2 * odd.count()
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


def test_warc_round_trip(spark):
    big = bytes(range(256)) * 20_000
    rows = [(1, "http://a/\r\nX: é", big), (2, None, big), (3, "u", None), (4, "u", b""), (5, "u", b"short"), (6, "u", b"short"), (None, "u", big), (2, "v", big), (7, "WARC/1.1", b"\r\n\r\nWARC/1.1\r\n\r\n" * 20)]
    df = spark.createDataFrame(rows, "id long, uri string, payload binary").repartition(3)
    manifest = warc.write(warc.planned(df), common.scratch_path(spark, "warc"), roll=1000)
    out = warc.chunks(manifest, step=100_000).collect()
    assert max(len(r.data) for r in out) <= 100_000
    found = {}
    for r in sorted(out, key=lambda r: (str(r.record_id), str(r.uri), r.chunk_no)):
        found.setdefault((r.record_id, r.uri), []).append(r)
    one = found[("1", [k[1] for k in found if k[0] == "1"][0])]
    assert b"".join(r.data for r in one) == big and len(one) > 10 and one[-1].last
    assert one[3].digest_so_far == hashlib.sha256(big[: one[3].bytes_so_far]).hexdigest()
    kinds = sorted((r.record_id, r.record_type, r.refers_to) for r in out if r.last)
    assert [k for k in kinds if k[1] == "revisit"] == [("", "revisit", "1"), ("2", "revisit", "1"), ("2", "revisit", "1")]
    assert len(kinds) == len(rows)
    assert warc.chunks(warc.write(warc.planned(df.limit(0)), common.scratch_path(spark, "warc"))).count() == 0


def test_warc_errors():
    row = {"record_type": "response", "id": 1, "uri": None, "digest": "0" * 64, "bytes": 3, "payload": b"abc", "refers_to": None}
    assert [(r["last"], bool(r["error"])) for r in warc.parse(iter([b"".join(warc.record_parts(row))]))] == [(True, True)]
    good = b"".join(warc.record_parts(row | {"digest": hashlib.sha256(b"abc").hexdigest()}))
    assert [r["data"] for r in warc.parse(iter([good[i : i + 7] for i in range(0, len(good), 7)]))] == [b"abc"]
    assert [r["data"] for r in warc.parse(iter([good[:-4]]))] == [b"abc"]
    assert [(r["record_id"], r["data"], r["error"]) for r in warc.parse(iter([good[:-5]]))] == [("1", b"ab", None), ("1", b"", "a record ends early")]


def test_warc_of_other_writers():
    import base64
    import gzip

    page = b"<html>hello</html>" * 300
    digest = base64.b32encode(hashlib.sha1(page).digest()).decode()

    def record(kind, block, *more):
        head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}>", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"])
        return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    kinds = "content-type: application/http; msgtype=response"
    records = [
        record("warcinfo", b"software: x\r\nformat: WARC File Format 1.0\r\n\r\n", "Content-Type: application/warc-fields"),
        record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        record("response", http + page, kinds, f"WARC-Payload-Digest: sha1:{digest}", "WARC-Target-URI: http://a/", "X-Folded: a", " b"),
        record("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n", kinds, f"WARC-Payload-Digest: sha1:{digest}"),
        record("revisit", http, kinds, f"WARC-Payload-Digest: sha1:{digest}", "WARC-Refers-To: <urn:uuid:response>"),
        record("resource", page, "Content-Type: text/html"),
        record("metadata", b""),
    ]
    for packed in (b"".join(records), b"".join(map(gzip.compress, records))):
        import io

        rows = list(warc.parse(warc.inflated(io.BytesIO(packed).read, 700), 700))
        ends = [r for r in rows if r["last"]]
        assert [r["record_type"] for r in ends] == ["warcinfo", "request", "response", "response", "revisit", "resource", "metadata"]
        assert ends[2]["payload_digest"] == digest and ends[2]["payload_bytes"] == len(page) and ends[2]["uri"] == "http://a/" and ends[2]["chunk_no"] > 5
        assert ends[2]["digest_so_far"] == ends[5]["digest_so_far"] == hashlib.sha256(page).hexdigest()
        assert ends[4]["refers_to"] == "urn:uuid:response" and ends[4]["bytes_so_far"] == 0 and ends[4]["payload_bytes"] is None
    wrong = record("response", http + page[1:], kinds, f"WARC-Payload-Digest: sha1:{digest}")
    assert [bool(r["error"]) for r in warc.parse(iter([wrong])) if r["last"]] == [True]


def test_url_odd(spark):
    urls = [None, "", "no scheme", "x://", "X://Org", "x://ORG/", "x://a.org/?/", "http://example.org/en/1", "http://sub.example.org/es/x", "http://notexample.org/es/", "http://com/fr/#", "a://b://c.com/de/", "http://user@x.com:80/de/"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, url_filter.RULES).orderBy("page_id").collect()]
    none = ("", "", None, "allow")
    assert out == [none, none, none, none, ("org", "", None, "allow"), ("org", "/", "org/", "allow"), ("a.org", "/", "org/", "allow"), ("example.org", "/en/1", "example.org/en/1", "block"), ("sub.example.org", "/es/x", "example.org/es/", "block"), ("notexample.org", "/es/", "org/", "allow"), ("com", "/fr/", "com/fr/", "allow"), ("b:", "//c.com/de/", None, "allow"), ("user@x.com:80", "/de/", None, "allow")]
    assert url_filter.judge(df.limit(0), url_filter.RULES).count() == 0
    assert url_filter.judge(df, []).where("rule is not null").count() == 0


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    listed = keys.where("key % 3 = 0")
    cascade = url_filter.Cascade.of(listed, keys)
    assert len(cascade.levels) > 2
    assert keys.where(cascade.has(F.col("key")) != (F.col("key") % 3 == 0)).count() == 0
    assert not spark.range(1).select(url_filter.Cascade.of(listed.limit(0), keys).has(F.lit("3"))).head()[0]
    hashes, words = url_filter.Cascade.of(spark.range(4).select(F.col("id").cast("string").alias("key")), keys).levels[0]
    assert hashes == 10 and 64 * len(words) < 4 * 16 + 64  # the few listed keys take more hashes, so that few others are taken wrongly


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, **size: (kind, text, ref, *(size.get(k) for k in ("width", "height", "millis", "pages")))
    said = [part("text", "look: <|image|> \\ "), part("image", ref="i.png", width=28, height=30), part("audio", ref="a.wav", millis=1010)]
    rows = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", [part("document", ref="d.pdf", pages=2), part("text", "done</s>")]), (2, 0, None, None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    out = {r.conv_id: r for r in chat.chats(rows, text=None, parts="parts").withColumn("said", chat.loss_text(F.col("formatted"), F.col("turn_loss"))).withColumn("turns", chat.turns_of(F.col("formatted"))).collect()}
    assert [(a.kind, a.ref, a.tokens) for a in out[1].attachments] == [("image", "i.png", 6), ("audio", "a.wav", 26), ("document", "d.pdf", 2048)]
    assert out[1].expanded_tokens == 2080 and out[1].formatted.count("<|image|>") == 1
    assert out[2].n_turns == 1 and out[2].expanded_tokens == 0 and out[2].turns[0].text == ""


def test_chat_escapes(spark):
    rng = random.Random(3)
    parts = [*chat.CONTROLS, "\\", "<", "[", "\n", "ok", "é", "</", "s>", "$1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(300)]
    rows = [(i, t, rng.choice(["user", "assistant", "system", "tool[TEXT]", "", None]), texts[(i * 3 + t) % 300]) for i in range(100) for t in range(3)]
    df = spark.createDataFrame(rows + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    out = chat.chats(df).withColumn("turns", chat.turns_of(F.col("formatted"))).withColumn("said", chat.loss_text(F.col("formatted"), F.col("turn_loss"))).collect()
    assert len(out) == 101
    for r in out:
        mine = [x for x in rows if x[0] == r.conv_id] or [(None, None, None, None)]
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in mine]
        assert r.said == "".join(x[3] for x in mine if x[2] == "assistant")


def test_html_held_out():
    model = html_extract.trained()
    right = total = 0
    for seed in range(50_000, 50_150):
        page, labels = labelled_page(seed)
        blocks = leaf_blocks(page)
        assert len(blocks) == len(labels)
        right += sum(a == b for a, b in zip(model.label(features(blocks)), labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_is_best():
    model = html_extract.Model({"a": 1.5, "b": -1.0, "c": 0.2}, ((0.4, -0.7), (-0.3, 0.6)))
    rng = random.Random(0)
    score = lambda f, y: sum(sum(model.weights[x] for x in g) * v for g, v in zip(f, y)) + sum(model.moves[a][b] for a, b in zip(y, y[1:]))
    for _ in range(50):
        f = [[rng.choice("abc") for _ in range(2)] for _ in range(6)]
        best = max((tuple(int(b) for b in f"{i:06b}") for i in range(64)), key=lambda y: score(f, y))
        assert score(f, model.label(f)) == pytest.approx(score(f, best))


def test_likelihood_gradient():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    labels = rng.integers(0, 2, (3, 5)) * mask
    value, d_scores, d_moves = html_extract.likelihood(scores, mask, labels, moves)
    for i, j in np.ndindex(3, 5):
        s = scores.copy()
        s[i, j] += 1e-6
        assert (html_extract.likelihood(s, mask, labels, moves)[0] - value) / 1e-6 == pytest.approx(d_scores[i, j], abs=1e-4)
    for i, j in np.ndindex(2, 2):
        m = moves.copy()
        m[i, j] += 1e-6
        assert (html_extract.likelihood(scores, mask, labels, m)[0] - value) / 1e-6 == pytest.approx(d_moves[i, j], abs=1e-4)


def test_html_odd(spark):
    deep = "<div>" * 20_000 + "<p>x y</p>"
    rows = [(1, None), (2, ""), (3, "<"), (4, "<!-- never closed <p>x"), (5, "<script>never closed <p>x"), (6, deep), (7, "<article><p>one<p>two &lt;b&gt;&nbsp;&#x41;</article>"), (8, '<p title="a>b">text</p>')]
    out = {r.page_id: r.main_text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, html string").withColumn("main_text", F.lit(1))).collect()}
    assert out[1] == out[2] == out[4] == out[5] == ""
    assert out[7] == "one two <b> A"
    assert [b.text for b in leaf_blocks(rows[7][1])] == ["text"]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


@pytest.mark.parametrize("quote", "\"'")
def test_html_long_attributes(quote):
    for n in (10, 1001, 4097, 300_000):
        page = f"<div data-props={quote}{'a' * n}<p>LEAK me</p>{quote} class={quote}footer{quote}><p>text</p></div>"
        (block,) = leaf_blocks(page)
        assert block.text == "text" and block.inherited == {"in div", "in p", "name footer"}
    many = "".join(f" data-{i}={quote}>{quote}" for i in range(100))
    assert [b.text for b in leaf_blocks(f"<p{many}>text</p>")] == ["text"]
    assert [b.text for b in leaf_blocks(f"<p title={quote}open>text</p>")] == ["text"]
    assert len(leaf_blocks(f"<p {quote}a>{quote}" * 30_000)) == 30_000
    assert len(leaf_blocks(f"<p {quote}>x" + "<p \">y".replace('"', "'" if quote == '"' else '"') * 30_001)) > 10_000


def test_html_any_depth():
    model = html_extract.trained()
    wrap = lambda inner, depth: "<div>" * depth + inner + "</div>" * depth
    said = "<p>The long story of the town is told here, with all its turns, by those who were there and saw it happen.</p>"
    for depth in (3, 14, 40, 3000):
        menu = wrap("<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul>", depth)
        page = f"<body><nav class='menu'>{menu}</nav><article>{wrap(said * 3, depth)}</article><footer class='footer'>{wrap('<p>All rights reserved.</p>', depth)}</footer></body>"
        assert html_extract.main_text(model, page) == " ".join([said[3:-4]] * 3)
    names = "".join(f"<div class='a{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}'>t" for i in range(10_000))
    assert len(leaf_blocks(names, model.weights)) == 10_000


def test_html_elements_that_never_end():
    import time

    began = time.time()
    for tag in ("svg", "canvas", "noscript", "iframe"):
        leaf_blocks(f"<{tag}>" * 50_000)
    assert time.time() - began < 4
    assert [b.text for b in leaf_blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>")] == ["so x=1 holds"]


def test_components_of_edges_that_come_out_otherwise_each_time(spark):
    """A spanning forest of the same group may differ between two evaluations of its plan."""
    n = 60
    drawn = spark.range(1, n).withColumn("b", F.floor(F.rand() * F.col("id")).cast("long"))  # each node hangs on a random earlier one
    edges = drawn.select(F.when(F.rand() < 0.5, F.col("id")).otherwise(F.col("b")).alias("a"), F.col("id").alias("i"), F.col("b"))
    edges = edges.select("a", (F.col("i") + F.col("b") - F.col("a")).alias("b"))
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == dict.fromkeys(range(n), 0)
