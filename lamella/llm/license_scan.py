"""Licence scans by a positional index of rare words, in DataFrame functions only.

Every licence template is a run of words. The index holds, for each template, the half of its words that are rarest among the
documents (highest IDF), each with its position. A file's words that the index has are looked up; a posting at position q that
meets the word at p speaks for the template lying at p - q. What speaks for one place is summed: where enough of a template's
rare words stand at the right distances from each other, its mandatory phrases are looked for, and it is found if all of them
stand there whole. Common words are looked at in the files alone that have come so far.

Texts are read once: the places of all words of all templates are written, and what is rare is counted from them.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lowered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, others, sized

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Of a template's summed IDF, what has to stand in place.
ENOUGH = 0.6

#: Phrases that name a licence wherever they stand, and the label of each.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    """A licence text's words, and the phrases in it that must stand whole."""

    label: str
    text: str
    phrases: tuple[str, ...]

    def postings(self) -> list[tuple[str, int, bool]]:
        """(word, position, mandatory)."""
        words = self.text.split()
        must: set[int] = set()
        for phrase in self.phrases:
            wanted = phrase.split()
            at = next((i for i in range(len(words)) if words[i : i + len(wanted)] == wanted), None)
            if at is None:
                raise ValueError(f"{phrase!r} isn't in the template of {self.label}")
            must |= set(range(at, at + len(wanted)))
        return [(w, q, q in must) for q, w in enumerate(words)]


#: Sentences of published licences and of the notices that refer to them, lower-cased and without punctuation.
TEMPLATES = (
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    Template("gpl", "licensed under the gnu general public license version", ("gnu general public license",)),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ("without warranties or conditions of any kind",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
)


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lowered; none of a null.

    ``lower`` folds other letters as well. None of those changes what is a word, and of them only the Kelvin sign becomes an
    ASCII letter, so it is put out of the way: the words that are looked up are ASCII."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9"))), F.lit(WORD), F.lit(0))


def _places(words: str, at: str, phrase: str) -> Column:
    """Where the words of ``phrase`` stand one after the other; ``at`` has all places that come into question."""
    wanted = phrase.split()
    return F.filter(at, lambda p: reduce(Column.__and__, [F.coalesce(F.get(F.col(words), p + i) == w, F.lit(False)) for i, w in enumerate(wanted)]))


def rarity(hits: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """The IDF of each word of ``vocabulary`` over all rows of ``hits`` (ws: a row's words of the vocabulary), in thousandths, 1 at
    least: as many numbers as the templates have words."""
    counts = hits.select(F.explode(F.array_append(F.array_distinct("ws"), F.lit(""))).alias("w")).groupBy("w").count()  # "": every row
    df = {r["w"]: r["count"] for r in counts.collect()}
    return {w: math.floor(1000 * math.log((df.get("", 0) + 1) / (df.get(w, 0) + 1))) + 1 for w in vocabulary}


def index(templates: Sequence[Template], idf: dict[str, int]) -> list[tuple[str, int, int, str, int, int, int]]:
    """Postings (word, template, position, label, idf, total, needed) of each template's rarer half, with the summed IDF of all of
    the template's and the number of its mandatory words."""
    out = []
    for n, t in enumerate(templates):
        every = t.postings()
        distinct = sorted({w for w, _, _ in every}, key=lambda w: (-idf[w], w))
        rare = set(distinct[: -(-len(distinct) // 2)])
        total, needed = sum(idf[w] for w, _, _ in every if w in rare), sum(m for _, _, m in every)
        out += [(w, n, q, t.label, idf[w], total, needed) for w, q, _ in every if w in rare]
    return out


def scan(docs: DataFrame, text: str = "text", templates: Sequence[Template] = TEMPLATES, phrases: dict[str, str] | None = None, enough: float = ENOUGH) -> DataFrame:
    """``docs`` without ``text``, with n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of ``phrases``, first_word and last_word are the smallest and largest of them (null if there are
    none), base_labels their labels; labels has those of the templates found too; both are distinct, sorted, comma-joined. score
    is the greatest share of a found template's rare words, by IDF, that stands in place, 0 where none is found.

    A null or empty text has no words and no label; equal rows are judged alike, each as a row of its own; columns of ``docs``
    named as a result are replaced; an empty table gives no rows. A text of any length is one row's array of words; what it has
    to say for templates is spread by template and place."""
    spark = docs.sparkSession
    phrases = PHRASES if phrases is None else phrases
    results = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kept = [f.name for f in others(docs, (*results, text))]
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    wanted = sorted({w for p in phrases for w in p.split()} | set(vocabulary))
    rows = docs.select(*kept, words_of(F.col(text)).alias("_lamella_ws"))
    rows = rows.withColumn("_lamella_at", F.array_compact(F.transform("_lamella_ws", lambda w, i: F.when(w.isin(*wanted), i))))
    places = {p: _places("_lamella_ws", "_lamella_at", p) for p in phrases}
    rows = rows.withColumns({f"_lamella_p{i}": p for i, p in enumerate(places.values())})
    found = [f"_lamella_p{i}" for i in range(len(phrases))]
    every = F.concat(*found) if found else F.array().cast("array<int>")
    labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, label in zip(found, phrases.values(), strict=True)])))) if found else F.array().cast("array<string>")
    base = rows.select(
        *kept,
        F.monotonically_increasing_id().alias("_lamella_row"),
        F.size("_lamella_ws").cast("long").alias("n_words"),
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        labels.alias("_lamella_base"),
        "_lamella_at",
        F.transform("_lamella_at", lambda p: F.get(F.col("_lamella_ws"), p)).alias("_lamella_hit"),
    )
    base = materialise(base, "words")  # written: a row's number stays what it is
    postings = index(templates, rarity(base.select(F.col("_lamella_hit").alias("ws")), vocabulary))
    if not postings:
        made = base.withColumn("_lamella_labels", F.array().cast("array<string>")).withColumn("score", F.lit(0.0))
    else:
        table = lambda values, names: F.broadcast(spark.sql(f"SELECT * FROM VALUES {', '.join(values)} AS v({names})"))  # noqa: E731  as long as the templates
        hits = base.select("_lamella_row", F.inline(F.arrays_zip(F.col("_lamella_at").alias("p"), F.col("_lamella_hit").alias("w"))))
        rare = table([f"('{w}', {t}, {q}, '{label}', {i}L, {total}L, {needed}L)" for w, t, q, label, i, total, needed in postings], "w, t, q, label, idf, total, needed")
        spoken = hits.join(rare, "w").groupBy("_lamella_row", "t", "label", "total", "needed", (F.col("p") - F.col("q")).alias("place")).agg(F.sum("idf").alias("got"))
        likely = materialise(spoken.where(F.col("got") >= F.col("total") * enough), "likely")
        must = table([f"('{w}', {n}, {q})" for n, t in enumerate(templates) for w, q, m in t.postings() if m] or ["('', -1, 0)"], "w, t, q")
        files = sized(materialise(likely.select("_lamella_row").distinct(), "files", 1))
        standing = hits.join(files, "_lamella_row", "left_semi").join(must, "w").groupBy("_lamella_row", "t", (F.col("p") - F.col("q")).alias("place")).agg(F.count("*").alias("musts"))
        good = likely.join(standing, ["_lamella_row", "t", "place"], "left").where(F.coalesce("musts", F.lit(0)) == F.col("needed"))
        labelled = materialise(good.groupBy("_lamella_row").agg(F.collect_set("label").alias("_lamella_labels"), F.max(F.col("got") / F.col("total")).alias("score")), "labels")
        made = base.join(sized(labelled), "_lamella_row", "left")
    joined = F.array_sort(F.array_union("_lamella_base", F.coalesce("_lamella_labels", F.array().cast("array<string>"))))
    return made.select(*kept, "n_words", "n_base", "first_word", "last_word", F.array_join("_lamella_base", ",").alias("base_labels"), F.array_join(joined, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_VALUES = ", ".join(f"({n}, '{t.label}', '{w}', {q}, {int(m)})" for n, t in enumerate(TEMPLATES) for w, q, m in t.postings())
_PHRASES = ", ".join(f"({i}, '{p}', '{label}')" for i, (p, label) in enumerate(PHRASES.items()))
OP11_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
e AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM w),
ph AS (SELECT n, label, string_split(phrase, ' ') AS pw FROM (VALUES {_PHRASES}) v(n, phrase, label)),
pp AS (SELECT n, label, len(pw) AS size, unnest(pw) AS w, generate_subscripts(pw, 1) - 1 AS q FROM ph),
b AS (SELECT doc_id, label, p - q AS pos FROM e JOIN pp USING (w) GROUP BY doc_id, n, label, p - q HAVING count(*) = max(size)),
bs AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS bl FROM b GROUP BY doc_id),
t(t, label, w, q, must) AS (VALUES {_VALUES}),
df AS (SELECT w, count(DISTINCT doc_id) AS df FROM e WHERE w IN (SELECT w FROM t) GROUP BY w),
idf AS (SELECT DISTINCT t.w, CAST(floor(1000 * ln(((SELECT count(*) FROM documents) + 1e0) / (coalesce(df, 0) + 1e0))) + 1 AS BIGINT) AS idf FROM t LEFT JOIN df ON t.w = df.w),
tw AS (SELECT t, w, row_number() OVER (PARTITION BY t ORDER BY idf DESC, w) AS r, count(*) OVER (PARTITION BY t) AS n FROM (SELECT DISTINCT t, w FROM t) JOIN idf USING (w)),
held AS (SELECT t.*, CASE WHEN r <= (n + 1) // 2 THEN idf ELSE 0 END AS idf FROM t JOIN tw USING (t, w) JOIN idf USING (w)),
tot AS (SELECT t, sum(idf) AS total, sum(must) AS needed FROM held GROUP BY t),
al AS (SELECT doc_id, t, label, sum(idf) AS got, sum(must) AS musts FROM e JOIN held USING (w) GROUP BY doc_id, t, label, p - q),
ok AS (SELECT doc_id, label, CAST(got AS DOUBLE) / CAST(total AS DOUBLE) AS score FROM al JOIN tot USING (t) WHERE musts = needed AND got >= total * CAST({ENOUGH} AS DOUBLE)),
ls AS (SELECT doc_id, list(DISTINCT label) AS ml, max(score) AS score FROM ok GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       array_to_string(list_sort(coalesce(bl, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(ml, [])))), ',') AS labels, coalesce(score, 0e0) AS score
FROM w LEFT JOIN bs ON w.doc_id = bs.doc_id LEFT JOIN ls ON w.doc_id = ls.doc_id
"""
