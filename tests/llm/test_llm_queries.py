"""Queries with SQL against it, over the smallest tables, and the pipeline against its parts."""

import pytest

from lamella.llm.registry import ORACLES, QUERIES

from ..conftest import SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same):
    assert same(QUERIES[name], ORACLES[name]) > 0


def test_token_counts(spark):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    from lamella.llm.bpe import default_path

    tk = Tokenizer.from_file(default_path())
    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    want = {}
    for d in docs:
        for version, n in (("byte_bpe_50k/1", len(tk.encode(d["text"] or "", add_special_tokens=False).ids)), ("words/1", len((d["text"] or "").split()))):
            key = (d["source"], d["lang"], version)
            a, b = want.get(key, (0, 0))
            want[key] = a + 1, b + n
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in QUERIES["op1_token_counts"](spark, SMALL).collect()}
    assert got == want


def test_quality_counts(spark):
    import pyarrow.parquet as pq

    docs = {d["doc_id"]: (d["text"] or "") for d in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist()}
    out = QUERIES["op4_quality"](spark, SMALL).collect()
    assert len(out) == len(docs)
    for r in out:
        words = docs[r.doc_id].encode().split()
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        twice = {w for w in windows if windows.count(w) > 1} if len(set(windows)) < len(windows) else set()
        hit = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
        lines = [x for x in docs[r.doc_id].split("\n") if x.strip(" \t\r\x0b\x0c")]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(words), len(hit), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(w.decode()) for w in words)
        assert r.n_symbols == sum(docs[r.doc_id].count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(words) < 20 or 100 * len(hit) > 30 * len(words))
        assert not (r.base_failed and r.kept)
    good = [r.kept for r in out if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in out if labels.get(r.doc_id) == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_packing_round_trip(spark):
    import zlib

    import numpy as np
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    from lamella.llm.bpe import default_path

    tk = Tokenizer.from_file(default_path())
    ids = {d["doc_id"]: np.array([*tk.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4") for d in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    rows = QUERIES["op5_packing"](spark, SMALL).toPandas()
    assert set(rows.doc_id) == set(ids)
    for d, g in rows.sort_values("start").groupby("doc_id"):
        assert g.start.tolist() == np.concatenate(([0], np.cumsum(g.length)[:-1])).tolist()
        assert g.length.sum() == len(ids[d]) == g.doc_tokens.iloc[0]
        for r in g.itertuples():
            assert zlib.crc32(ids[d][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for k, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.concatenate(([0], np.cumsum(g.length)[:-1])).tolist()
        assert g.length.sum() == 2048 or k == rows.sequence_id.max()


def test_pages(spark):
    import html
    import re

    import pyarrow.parquet as pq

    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{SMALL}/pages.parquet").to_pylist()}
    for r in QUERIES["op7_html_extract"](spark, SMALL).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        assert (r.text, r.n_chars) == (want, len(want))


def test_pipeline(spark):
    import corpus_pipeline as p
    from lamella.llm.ngram_join import shingle_sets

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = p.quality_rules(spark, docs, SMALL)
    assert kept.columns == docs.columns
    one = p.near_copies(spark, kept, SMALL).collect()
    ids = [r.doc_id for r in one]
    assert len(set(ids)) == len(ids)
    sets = dict(zip(ids, map(set, map(list, shingle_sets([r.text.encode() for r in one], 3)))))
    for a in ids:
        for b in ids:
            if a < b:
                assert len(sets[a] & sets[b]) < 0.9 * len(sets[a] | sets[b])
    out = p.run(spark, SMALL).collect()
    assert {r.doc_id for r in out} <= set(ids)
    assert [n for n, _ in p.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "packing"]
