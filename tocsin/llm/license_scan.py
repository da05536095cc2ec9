"""License scans: phrases, and an exact set-similarity join with notices.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
Labels come from two places:

* phrases whose words stand consecutively anywhere in the text (base labels);
* a set-similarity join of all text blocks with the notices of ``NOTICES``: a
  block has a notice's label if it contains at least ``threshold`` of the
  notice's distinct words.  Blocks are the lines and, so that wrapped notices
  are found, every run of ``SPAN`` times a notice's words across line breaks.

The join is exact.  Words of notices are put in a global order, rarest first,
by the number of documents that hold them, counted over all documents.  Notice
T with need ``n = ceil(threshold * |T|)`` shares at least one of its first
``|T| - n + 1`` words (its prefix) with every block that qualifies, so only
those words are joined on.  Blocks are reduced to words of some notice; blocks
with fewer than the smallest need are out (length filter), and a pair is out
if the words behind the shared one, on either side, can no longer reach the
need (positional filter).  What is left is verified by intersection.  Runs go
through these filters in windows that overlap by the longest run, so each run
is whole in one; the runs of the windows left are verified one by one.

The notices are fixed, so the index that is joined against is bounded by them
and not by the data; it is the only broadcast.  Only DataFrame and SQL
functions are used.

Defined cases: null text counts as empty (0 words, no labels, score 0);
repeated rows give equal rows; null ids are kept; blocks may be of any length;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import stored, text_of

#: Words of lower-cased texts.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: phrase: label
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: (label, notice): usual wordings of public licenses.
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
               "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("mit", "Released under the terms of the MIT license"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
)
THRESHOLD = 0.9
#: Words of a run as a multiple of the notice's, for comment marks that are words.
SPAN = 2


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def notice_sets(notices=NOTICES) -> list[tuple[str, list[str]]]:
    """Distinct ASCII words of each notice, by the rule for texts."""
    return [(label, sorted(set(notice_words(notice)))) for label, notice in notices]


def notice_words(notice: str) -> list[str]:
    kept = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in notice.translate(str.maketrans(UPPER, LOWER)))
    return kept.split()


def phrase_places(words: Column, phrases: dict[str, str] = PHRASES) -> Column:
    """array of (label, start) for all places, by the phrases' last words."""
    def at(_: Column, i: Column) -> Column:
        found = None
        for phrase, label in phrases.items():
            parts = phrase.split()
            n = len(parts)
            fits = reduce(lambda a, b: a & b,
                          [F.coalesce(F.get(words, i - (n - 1 - k)) == p, F.lit(False)) for k, p in enumerate(parts)])
            place = F.struct(F.lit(label).alias("label"), (i - (n - 1)).cast("long").alias("start"))
            found = F.when(fits, place) if found is None else found.when(fits, place)
        return found
    return F.filter(F.transform(words, at), lambda p: p.isNotNull())


def key_of() -> Column:
    """Names a text; repeated rows share it and what is found for it."""
    return F.struct(F.xxhash64(text_of()).alias("hash"), F.char_length(text_of()).alias("size"))


def text_facts(docs: DataFrame, vocabulary: list[str], phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, key, n_words, places, held) for each row: the one pass over all
    words.  ``held``: which words of the vocabulary the text has."""
    # The words are a column of their own before they are used: inside a lambda
    # the expression would be evaluated for every word.
    rows = docs.select("doc_id", key_of().alias("key"), words_of(text_of()).alias("words"))
    last_words = F.array(*map(F.lit, sorted({p.split()[-1] for p in phrases})))
    none = F.array().cast("array<struct<label:string,start:bigint>>")
    return rows.select("doc_id", "key", F.size("words").cast("long").alias("n_words"),
                       F.when(F.arrays_overlap("words", last_words), phrase_places(F.col("words"), phrases))
                       .otherwise(none).alias("places"),
                       F.array_intersect(F.array(*map(F.lit, vocabulary)), F.col("words")).alias("held"))


def word_order(facts: DataFrame, vocabulary: list[str]) -> list[str]:
    """The notices' words, rarest first, by documents that hold them.  The
    result is as long as the notices make it."""
    held = facts.select(F.explode("held").alias("word"))
    counts = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def prefix_index(spark, sets: list[tuple[str, list[str]]], order: list[str], threshold: float,
                 spans: list[int]) -> DataFrame:
    """One row per prefix word of a notice: word, place in the notice, label,
    words, need, span (words of a run)."""
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for notice, (label, words) in enumerate(sets):
        words = sorted(words, key=rank.__getitem__)
        need = max(1, math.ceil(threshold * len(words) - 1e-9))
        for place, word in enumerate(words[:len(words) - need + 1]):
            rows.append(F.struct(
                F.lit(word).alias("word"), F.lit(place).alias("place"), F.lit(notice).alias("notice"),
                F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("words"), F.lit(need).alias("need"),
                F.lit(spans[notice]).alias("span")))
    return spark.range(1).select(F.explode(F.array(*rows)).alias("_")).select("_.*")


def vocabulary_of(notices=NOTICES) -> list[str]:
    return sorted({w for _, words in notice_sets(notices) for w in words})


def similarity_join(docs: DataFrame, facts: DataFrame, notices=NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, block, label, containment) of all pairs that qualify.  ``facts``: see
    ``text_facts``, over the same rows."""
    sets = notice_sets(notices)
    order = word_order(facts, vocabulary_of(notices))
    spans = [SPAN * len(notice_words(notice)) for _, notice in notices]
    index = prefix_index(docs.sparkSession, sets, order, threshold, spans)
    least = min(max(1, math.ceil(threshold * len(words) - 1e-9)) for _, words in sets)
    ordered = F.array(*map(F.lit, order))
    # A block that qualifies has a prefix word, so its text has one.
    wanted_words = F.array(*map(F.lit, sorted({w for _, ws in sets for w in prefix_words(ws, order, threshold)})))
    texts = stored(facts.where(F.arrays_overlap("held", wanted_words)).select("key").distinct(), "license-texts")
    # The intersection keeps the first array's order: a block's words, rarest first.
    bodies = docs.select(key_of().alias("key"), text_of().alias("text")).join(texts, "key", "left_semi")
    blocks = (bodies.select("key", F.posexplode(F.split("text", "\n")).alias("block", "line"))
              .select("key", "block", F.array_intersect(ordered, words_of(F.col("line"))).alias("held"),
                      F.lit(None).cast("array<string>").alias("window")))
    # Runs across line breaks: windows of two strides hold every run of one.
    stride = max(spans)
    windows = (bodies.where(F.contains("text", F.lit("\n"))).select("key", words_of(F.col("text")).alias("words"))
               .select("key", "words", F.posexplode(F.sequence(
                   F.lit(1), F.greatest(F.size("words") - stride, F.lit(1)), F.lit(stride))).alias("no", "start"))
               .select("key", (-1 - F.col("no")).alias("block"), F.slice("words", F.col("start"), 2 * stride).alias("window"))
               .select("key", "block", F.array_intersect(ordered, F.col("window")).alias("held"), "window"))
    blocks = (blocks.unionByName(windows)
              .where((F.size("held") >= least) & F.arrays_overlap("held", wanted_words)))
    pairs = (blocks.select("key", "block", "held", "window", F.posexplode("held").alias("at", "word"))
             .join(F.broadcast(index), "word")
             .where((F.least("at", "place") + F.least(F.size("held") - F.col("at"), F.size("words") - F.col("place"))
                     >= F.col("need")) & (F.size("held") >= F.col("need"))))
    pairs = (pairs.where(F.size(F.array_intersect("held", "words")) >= F.col("need"))
             .dropDuplicates(["key", "block", "notice"]))
    starts = F.sequence(F.lit(1), F.greatest(F.size("window") - F.col("span") + 1, F.lit(1)))
    in_run = F.array_max(F.transform(starts, lambda at: F.size(
        F.array_intersect(F.slice("window", at, F.col("span")), F.col("words")))))
    shared = F.when(F.col("window").isNull(), F.size(F.array_intersect("held", "words"))).otherwise(in_run)
    return (pairs.select("key", "block", "notice", "label", shared.alias("shared"), "need", "words")
            .where(F.col("shared") >= F.col("need"))
            .select("key", "block", "notice", "label", (F.col("shared") / F.size("words")).alias("containment")))


def prefix_words(words: list[str], order: list[str], threshold: float) -> list[str]:
    need = max(1, math.ceil(threshold * len(words) - 1e-9))
    return sorted(words, key=order.index)[:len(words) - need + 1]


def scan(docs: DataFrame, notices=NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, places, notice_labels and
    containment (the highest; 0 if no block qualifies)."""
    facts = stored(text_facts(docs, vocabulary_of(notices)), "license-facts")
    found = (similarity_join(docs, facts, notices, threshold).groupBy("key")
             .agg(F.collect_set("label").alias("notice_labels"), F.max("containment").alias("containment")))
    return (facts.join(found, "key", "left")
            .select("doc_id", "n_words", "places",
                    F.coalesce("notice_labels", F.array().cast("array<string>")).alias("notice_labels"),
                    F.coalesce("containment", F.lit(0.0)).alias("containment")))


def summary(scanned: DataFrame) -> DataFrame:
    starts = F.transform("places", lambda p: p.start)
    labels = F.transform("places", lambda p: p.label)
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.col("notice_labels"))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.col("containment")).alias("score"))


def oracle(notices=NOTICES, threshold: float = THRESHOLD) -> str:
    """The same in SQL, without any filter: every line against every notice.  Runs
    across line breaks are not in it."""
    rows = ", ".join(
        f"({k}, '{label}', [{', '.join(repr(w) for w in words)}], {max(1, math.ceil(threshold * len(words) - 1e-9))})"
        for k, (label, words) in enumerate(notice_sets(notices)))
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {low} AS low FROM documents),
w AS (SELECT doc_id, r, low, regexp_extract_all(low, '{WORD}') AS w FROM d),
n(notice, label, words, need) AS (VALUES {rows}),
b AS (SELECT r, regexp_extract_all(unnest(string_split(low, chr(10))), '{WORD}') AS held FROM d),
c AS (SELECT r, label, len(list_intersect(held, words)) AS shared, need, len(words) AS size
      FROM b, n WHERE len(held) >= need AND len(list_intersect(held, words)) >= need),
m AS (SELECT r, list(DISTINCT label) AS labels, max(shared / size) AS best FROM c GROUP BY r),
i AS (SELECT r, w, unnest(range(len(w))) AS i FROM w WHERE contains(low, 'license')),
p AS (SELECT r,
        CASE WHEN w[i + 1] = 'mit' AND w[i + 2] = 'license' THEN 'mit'
             WHEN w[i + 1] = 'apache' AND w[i + 2] = 'license' THEN 'apache'
             WHEN w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license' THEN 'gpl' END AS label, i
      FROM i),
s AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels
      FROM p WHERE label IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(s.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(s.labels, []), coalesce(m.labels, [])))), ',') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN s USING (r) LEFT JOIN m USING (r)
"""
