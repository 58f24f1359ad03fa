"""License scan by a positional index of rare words, in DataFrame functions only.

Templates are wordings of licences. Each is filed under its ``KEYS`` words that the fewest documents hold (counted
over all of them) and under the words of its mandatory phrase, with their places; short phrases are filed under all their words. A
document looks up its ``LOOKUPS`` licence words of the highest IDF. A template that enough of them point to is a candidate; the
places of its words in the document, less their places in the template, are the starts at which the template may stand, and
words that agree on a start set a bit each (a mask: merged by OR, of one size however often a word
repeats). A template is found at a start if all words of its mandatory phrase agree on it and the agreeing words hold ``SHARE`` of the weight of all
its filed words. Words are runs of ASCII digits and letters (A-Z in lower case) and of all characters beyond ASCII.

``BASE`` phrases are short templates whose every word is mandatory: they are looked up whatever else the document holds, and found
exactly where their words stand consecutively.

Defined results: a null text reads as empty. A null doc_id is a document like others; rows that repeat a doc_id are scanned each
for itself and come back as often as they are there. Rows are carried by (doc_id, digest of the text), so equal rows are one until
the end. Other columns are ignored. An empty table gives no rows. A text of any length is one row's array of words; what leaves it are only places
of candidates' words, grouped by start, so a file that repeats a licence many times is no single group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words a long template is filed under; licence words a document looks up; of a template's words as many must be among them; share of weight to agree on a start.
KEYS, LOOKUPS, NEED, SHARE = 12, 32, 4, 0.6

#: Label and phrase of the base scan.
BASE = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
#: Label and short wordings of other licences, identifiers and names; every word is mandatory.
SHORT = (
    ("agpl", "affero general public license"),
    ("apache", "spdx license identifier apache 2 0"),
    ("bsd", "bsd license"),
    ("bsd", "spdx license identifier bsd"),
    ("cc-by", "creative commons attribution"),
    ("cc-by", "licensed under cc by"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nd", "licensed under cc by nd"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("epl", "eclipse public license"),
    ("gpl", "spdx license identifier gpl"),
    ("isc", "isc license"),
    ("lgpl", "lesser general public license"),
    ("mit", "spdx license identifier mit"),
    ("mpl", "mozilla public license"),
    ("unlicense", "released into the public domain"),
)
#: Label, wording and mandatory phrase of licence texts and notices.
LONG = (
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "you may not use this file except in compliance",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you can redistribute it and or modify it",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "with or without fee is hereby granted",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge",
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "source code form is subject to the terms",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        "free and unencumbered software",
    ),
)
#: The Kelvin sign is a character beyond ASCII whose lower case is an ASCII letter; any other such letter may stand for it.
KELVIN, OTHER = "\u212a", "\u0138"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(OTHER))), F.lit(WORD), F.lit(0))


def find(whole: list[str], part: list[str]) -> int:
    return next(i for i in range(len(whole)) if whole[i : i + len(part)] == part)


def wordings() -> list[tuple[str, list[str], list[str], str]]:
    """(label, words, mandatory words, kind) of every template."""
    short = [(label, w.split(), w.split(), kind) for kind, rows in (("base", BASE), ("short", SHORT)) for label, w in rows]
    return short + [(label, w.split(), m.split(), "long") for label, w, m in LONG]


def vocabulary() -> list[str]:
    return sorted({w for _, ws, _, _ in wordings() for w in ws})


def document_counts(texts: DataFrame, column: str = "text") -> tuple[int, dict[str, int]]:
    """Rows, and how many of them hold each word of the templates (the driver gets a number a word of ``vocabulary``)."""
    found = texts.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(F.lit(vocabulary()), words(F.col(column))))).alias("word"))
    counts = {r.word: r.n for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return counts.pop("", 0), counts


class Index:
    """Postings of the templates for given document counts: rare words first, ties by word."""

    def __init__(self, rows: int, counts: dict[str, int]):
        idf = {w: math.log((rows + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocabulary()}
        self.by_idf = sorted(idf, key=lambda w: (counts.get(w, 0), w))
        rank = {w: i for i, w in enumerate(self.by_idf)}
        self.postings: list[tuple[str, int, int, int]] = []
        self.templates: list[dict] = []
        for no, (label, ws, must, kind) in enumerate(wordings()):
            start = find(ws, must)
            keys = sorted(set(ws), key=rank.get)[: KEYS if kind == "long" else None]
            places = sorted({ws.index(w) for w in keys} | set(range(start, start + len(must))))
            self.postings += [(ws[p], no, p, 1 << b) for b, p in enumerate(places)]
            self.templates.append(
                {
                    "template": no,
                    "label": label,
                    "base": kind == "base",
                    "keys": keys,
                    "need": min(NEED, len(keys)) if kind == "long" else len(keys),
                    "short": kind != "long",
                    "filed": sorted({ws[p] for p in places}),
                    "must": sum(1 << b for b, p in enumerate(places) if start <= p < start + len(must)),
                    "weights": [idf[ws[p]] for p in places],
                }
            )

    def posting_rows(self, spark: SparkSession) -> DataFrame:
        rows = ", ".join(f"struct('{w}' AS word, {t} AS template, {p} AS at, {b}L AS bit)" for w, t, p, b in self.postings)
        return spark.range(1).selectExpr(f"inline(array({rows}))")

    def template_rows(self, spark: SparkSession) -> DataFrame:
        weights = lambda t: ", ".join(f"{x!r}D" for x in t["weights"])
        rows = ", ".join(f"struct({t['template']} AS template, '{t['label']}' AS label, {t['base']} AS base, {t['must']}L AS must, array({weights(t)}) AS weights)" for t in self.templates)
        return spark.range(1).selectExpr(f"inline(array({rows}))")

    def candidates(self, present: Column) -> Column:
        """The numbers of the templates that a document's licence words, highest IDF first, point to, as bits."""
        rare = F.slice(present, 1, LOOKUPS)
        hits = [F.when(F.size(F.array_intersect(F.lit(t["keys"]), present if t["short"] else rare)) >= t["need"], F.lit(1 << t["template"]).cast("long")).otherwise(F.lit(0).cast("long")) for t in self.templates]
        return sum(hits[1:], hits[0])

    def filed(self, candidates: Column) -> Column:
        """The words whose places the candidates ask for."""
        none = F.expr("cast(array() as array<string>)")
        return F.array_distinct(F.concat(*[F.when(candidates.bitwiseAND(F.lit(1 << t["template"]).cast("long")) != 0, F.lit(t["filed"])).otherwise(none) for t in self.templates]))


def starts(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, digest, n_words, template, start, bits, n): the words that agree on each start of a candidate; and a row
    without a template a document, n of them being equal."""
    spark = docs.sparkSession
    d = docs.select("doc_id", F.xxhash64("text").alias("digest"), words(F.col("text")).alias("words"))
    d = d.withColumn("present", F.array_intersect(F.lit(index.by_idf), F.col("words")))
    d = d.withColumn("candidates", index.candidates(F.col("present"))).withColumn("filed", index.filed(F.col("candidates")))
    # bound to one variable, the words asked for are made once a row and not once a word
    places = F.expr("flatten(transform(array(struct(words, filed)), d -> filter(transform(d.words, (w, i) -> struct(w AS word, i AS place)), x -> array_contains(d.filed, x.word))))")
    marker = F.expr("array(struct(cast(null AS string) AS word, cast(null AS int) AS place))")
    d = d.withColumn("places", F.when(F.col("candidates") != 0, F.concat(marker, places)).otherwise(marker))
    # inline would put a filter on the size of places in front, which makes them twice
    d = d.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), "candidates", F.inline_outer("places"))
    wanted = F.col("candidates").bitwiseAND(F.expr("shiftleft(1L, template)")) != 0
    hit = d.join(F.broadcast(index.posting_rows(spark)), "word", "left").where(F.col("word").isNull() | wanted)
    return hit.groupBy("doc_id", "digest", "n_words", "template", (F.col("place") - F.col("at")).cast("long").alias("start")).agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"))


def scan(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of docs with doc_id, text; the score is the largest
    share of a found template's weight, 0 if none is found."""
    docs = docs.select("doc_id", "text")
    index = Index(*document_counts(docs)) if index is None else index
    found = starts(docs, index).join(F.broadcast(index.template_rows(docs.sparkSession)), "template", "left")
    agreed = F.expr("aggregate(transform(weights, (w, i) -> IF(bits & shiftleft(1L, i) <> 0, w, 0D)), 0D, (t, w) -> t + w)")
    whole = F.expr("aggregate(weights, 0D, (t, w) -> t + w)")
    found = found.withColumn("share", agreed / whole)
    is_found = (F.col("bits").bitwiseAND(F.col("must")) == F.col("must")) & (F.col("share") >= SHARE)
    found = found.withColumn("found", F.coalesce(is_found, F.lit(False))).withColumn("in_base", F.col("found") & F.col("base"))
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(F.col(which), F.col("label")))), ",")
    out = found.groupBy("doc_id", "digest", "n_words").agg(
        F.max(F.when(F.col("template").isNull(), F.col("n"))).alias("rows"),
        F.count_if("in_base").alias("n_base"),
        F.min(F.when(F.col("in_base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("in_base"), F.col("start"))).alias("last_word"),
        names("in_base").alias("base_labels"),
        names("found").alias("labels"),
        F.round(F.coalesce(F.max(F.when(F.col("found"), F.col("share"))), F.lit(0.0)), 9).alias("score"),
    )
    # equal rows come back one by one, a thousand at once
    out = out.withColumn("some", F.explode(F.expr("transform(sequence(0L, (rows - 1) div 1000), i -> cast(least(1000L, rows - 1000 * i) AS int))")))
    out = out.withColumn("one", F.explode(F.array_repeat(F.lit(True), F.col("some"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The scan written out in SQL: document counts, ranks, candidates, starts and shares of the same wordings."""
    rows = ",\n  ".join(f"({no}, '{label}', '{kind}', '{' '.join(ws)}', {find(ws, must)}, {len(must)})" for no, (label, ws, must, kind) in enumerate(wordings()))
    return rf"""
WITH t(template, label, kind, wording, must_at, must_len) AS (VALUES
  {rows}
), tw AS (
  SELECT template, unnest(string_split(wording, ' ')) AS word, unnest(range(len(string_split(wording, ' ')))) AS pos FROM t
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), w AS (
  SELECT r, unnest(words) AS word, unnest(range(len(words))) AS place FROM d
), lw AS (
  SELECT * FROM w WHERE word IN (SELECT word FROM tw)
), df AS (
  SELECT v.word, count(DISTINCT lw.r) AS df FROM (SELECT DISTINCT word FROM tw) v LEFT JOIN lw ON lw.word = v.word GROUP BY v.word
), rk AS (
  SELECT word, row_number() OVER (ORDER BY df, word) AS rank, ln(((SELECT count(*) FROM d) + 1) / (df + 1)) + 1 AS idf FROM df
), keys AS (
  SELECT template, word FROM (
    SELECT template, word, kind, row_number() OVER (PARTITION BY template ORDER BY rank) AS n FROM (SELECT DISTINCT template, word FROM tw) JOIN rk USING (word) JOIN t USING (template)
  ) WHERE kind <> 'long' OR n <= {KEYS}
), filed AS (
  SELECT tw.template, word, pos, pos >= must_at AND pos < must_at + must_len AS must, idf FROM tw JOIN t ON t.template = tw.template JOIN rk USING (word)
  WHERE (pos >= must_at AND pos < must_at + must_len)
     OR (tw.template, word, pos) IN (SELECT (template, word, min(pos)) FROM tw WHERE (template, word) IN (SELECT (template, word) FROM keys) GROUP BY template, word)
), whole AS (
  SELECT template, sum(idf) AS weight, count(*) FILTER (must) AS musts FROM filed GROUP BY template
), held AS (
  SELECT r, word, row_number() OVER (PARTITION BY r ORDER BY rank) AS n FROM (SELECT DISTINCT r, word FROM lw) JOIN rk USING (word)
), sized AS (
  SELECT template, count(*) AS n_keys FROM keys GROUP BY template
), cand AS (
  SELECT r, template FROM held JOIN keys USING (word) JOIN sized USING (template) JOIN t USING (template) WHERE kind <> 'long' OR n <= {LOOKUPS}
  GROUP BY r, template HAVING count(*) >= CASE WHEN any_value(kind) = 'long' THEN least({NEED}, any_value(n_keys)) ELSE any_value(n_keys) END
), hits AS (
  SELECT DISTINCT lw.r, f.template, lw.place - f.pos AS start, f.pos, f.must, f.idf FROM lw JOIN filed f USING (word) JOIN cand c ON c.r = lw.r AND c.template = f.template
), found AS (
  SELECT r, template, start, sum(idf) / any_value(weight) AS share FROM hits JOIN whole USING (template) GROUP BY r, template, start
  HAVING count(*) FILTER (must) = any_value(musts) AND sum(idf) / any_value(weight) >= {SHARE}
), per AS (
  SELECT r, count(*) FILTER (kind = 'base') AS n_base, min(start) FILTER (kind = 'base') AS first_word, max(start) FILTER (kind = 'base') AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'base') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM found JOIN t USING (template) GROUP BY r
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  round(coalesce(score, 0), 9) AS score
FROM d LEFT JOIN per USING (r)
"""


ORACLE = _oracle()
