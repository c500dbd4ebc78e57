"""License notices: exact phrases, and an exact set-similarity join of text
blocks with notice templates, in DataFrame operations only.

A block is a window of words, whatever line breaks and marks stand between them,
as long as the template with room for foreign words; every
place of every text begins one.  It meets a template when it holds at least
``THRESHOLD`` of the template's distinct words, ``need`` of ``size``.

The template's words are put in one global order, rarest in the corpus first.  Then a
block that meets a template holds one of the first ``size - need + 1`` of its words
(prefix filter), so only places of such words, anchors, are looked at: no window is made
elsewhere.  An anchor is taken as the rarest word that block and template share.  Then
``need`` words from its own place in the order on must be in the text at all (length
filter), and also in the words that windows over the anchor can reach (positional
filter).  Only then windows are made, those that hold the anchor, and counted exactly.
A word's templates are found by a join, so many templates cost what their rarest words
cost.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
THRESHOLD = 0.9
# fixed values: notice templates and their labels
TEMPLATES = (
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"),
    ("cc-by", "licensed under creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)


def template_rows(templates: Sequence[tuple[str, str]] = TEMPLATES) -> list[tuple[int, str, list[str], int, int]]:
    """(number, label, distinct words, words needed, words of a window)"""
    out = []
    for k, (label, text) in enumerate(templates):
        words = sorted(set(text.split()))
        out.append((k, label, words, math.ceil(THRESHOLD * len(words) - 1e-9), math.ceil(len(text.split()) / THRESHOLD)))
    return out


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _words(docs: DataFrame) -> DataFrame:
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return docs.select("doc_id", F.array_remove(F.split(text, NOT_WORD), "").alias("words"))


def corpus_order(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> list[str]:
    """The words of all templates, those in the fewest texts first."""
    vocabulary = sorted({w for _, _, words, _, _ in template_rows(templates) for w in words})
    held = _words(docs).select(F.explode(F.array_intersect(_strings(vocabulary), "words")).alias("word"))
    counts = {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}  # a number for each template word
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def prefixes(order: list[str], templates: Sequence[tuple[str, str]] = TEMPLATES) -> list[tuple]:
    """(word, template, label, size, need, window, rest): the words of which a block
    that meets a template holds one, with the template's words from there on in the order."""
    place = {w: k for k, w in enumerate(order)}
    out = []
    for k, label, words, need, window in template_rows(templates):
        own = sorted(words, key=place.__getitem__)
        out += [(w, k, label, len(own), need, window, own[i:]) for i, w in enumerate(own[: len(own) - need + 1])]
    return out


def candidates(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One pass over the texts, with a row for each anchor and each template that it can
    belong to, and one with anchor -1 for each text:
    row, doc_id, n_words, p0 and on (starts of the phrases), anchor, template, label, size,
    long_enough, placed (whether the length and the positional filter let it pass), and
    best (the most words that a window over the anchor shares; null if it isn't made)."""
    spark = docs.sparkSession
    order = corpus_order(docs, templates)
    rarest = prefixes(order, templates)
    anchors = sorted({r[0] for r in rarest})
    rows = _words(docs).withColumn("held", F.array_intersect(_strings(sorted(order)), "words"))
    # phrases hold one of two words; the others' texts need no look at each place
    hint = F.array_contains("words", "license") | F.array_contains("words", "cc")
    places = F.sequence(F.lit(0), F.size("words") - 1)

    def starts(phrase: str) -> Column:
        parts = phrase.split()

        def here(i: Column) -> Column:
            test = F.get("words", i) == parts[0]
            for k, w in enumerate(parts[1:], 1):
                test = test & (F.get("words", i + k) == w)
            return F.coalesce(test, F.lit(False))

        return F.when(hint, F.filter(places, here)).otherwise(F.array().cast("array<int>"))

    none = F.array().cast("array<int>")
    at = F.when(F.size("words") > 0, F.filter(places, lambda i: F.get("words", i).isin(anchors))).otherwise(none)
    phrases = [starts(p).alias(f"p{k}") for k, (p, _) in enumerate(PHRASES)]
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), *phrases, "words", "held", F.array_append(at, F.lit(-1)).alias("at"))
    names = [f"p{k}" for k in range(len(PHRASES))]
    rows = rows.select("row", "doc_id", "n_words", *names, "words", "held", F.explode("at").alias("anchor"))
    rows = rows.withColumn("word", F.when(F.col("anchor") >= 0, F.get("words", F.col("anchor"))))
    index = spark.createDataFrame(rarest, "word string, template int, label string, size int, need int, window int, rest array<string>")
    rows = rows.join(F.broadcast(index), "word", "left")  # as many rows as templates have prefix words
    first = F.greatest(F.col("anchor") - F.col("window") + 1, F.lit(0))
    reached = F.slice("words", first + 1, F.col("anchor") - first + F.col("window"))
    long_enough = F.coalesce((F.col("n_words") >= F.col("need")) & (F.size(F.array_intersect("rest", "held")) >= F.col("need")), F.lit(False))
    rows = rows.select("row", "doc_id", "n_words", *names, "anchor", "template", "label", "size", "need", "window", "rest", long_enough.alias("long_enough"), (F.col("anchor") - first).alias("inner"), F.when(long_enough, reached).alias("reached"))
    placed = F.coalesce(F.size(F.array_intersect("rest", "reached")) >= F.col("need"), F.lit(False))
    rows = rows.withColumn("placed", placed)
    # windows begin with a shared word, as others hold no more
    begins = F.filter(F.sequence(F.lit(0), "inner"), lambda i: F.array_contains("rest", F.get("reached", i)))
    shared = F.transform(begins, lambda i: F.size(F.array_intersect("rest", F.slice("reached", i + 1, F.col("window")))))
    best = F.when(F.col("placed"), F.array_max(shared))
    return rows.select("row", "doc_id", "n_words", *names, "anchor", "template", "label", "size", "long_enough", "placed", F.when(best >= F.col("need"), best).alias("best"))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Labels per document.

    Null and empty texts have no words, no labels and score 0; repeated rows
    give repeated results; very long texts are read whole, and only the surroundings of
    anchors are held besides; an empty table gives no rows; further columns are not
    read.  ``score`` is 1 with a phrase, else the best template's share, else 0."""
    names = [f"p{k}" for k in range(len(PHRASES))]
    found = candidates(docs, templates).select("row", "doc_id", "n_words", *names, F.when(F.col("best").isNotNull(), F.col("label")).alias("label"), (F.col("best") / F.col("size")).alias("share"))
    # combined before the shuffle: of a text one row travels
    rows = found.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"), *(F.first(c).alias(c) for c in ("doc_id", "n_words", *names)))
    starts = F.concat(*names)
    of_base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)])))
    every = F.array_sort(F.array_union(of_base, F.col("more")))
    return rows.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(of_base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def oracle_sql() -> str:
    """The same by brute force in DuckDB: every window against every template."""

    def items(words: list[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    templates = ", ".join(f"({k}, '{label}', {items(words)}, {need}, {window})" for k, label, words, need, window in template_rows())
    tests = []
    for phrase, _ in PHRASES:
        parts = phrase.split()
        tests.append("list_filter(range(1, len(words) + 1), lambda i: " + " and ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(parts)) + ")")
    labels = ", ".join(f"case when len(p{k}) > 0 then '{label}' end" for k, (_, label) in enumerate(PHRASES))
    return f"""
with texts as (select doc_id, row_number() over () as r, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
split as (select doc_id, r, t, list_filter(regexp_split_to_array(t, '{NOT_WORD}'), lambda w: w <> '') as words from texts),
placed as (select doc_id, r, len(words) as n_words, {", ".join(f"{t} as p{k}" for k, t in enumerate(tests))} from split),
templates(k, label, own, need, size) as (values {templates}),
windows as (select r, label, own, need, list_intersect(own, words[i : i + size - 1]) as held
  from (select r, label, own, need, size, words, unnest(list_filter(range(1, len(words) + 1), lambda i: list_contains(own, words[i]))) as i
        from split, templates where len(list_intersect(own, words)) >= need)),
met as (select distinct r, label, len(held)::double / len(own) as share from windows where len(held) >= need),
more as (select r, list(distinct label) as labels, max(share) as share from met group by r)
select doc_id, n_words::bigint as n_words,
  (len(p0) + len(p1) + len(p2) + len(p3))::bigint as n_base,
  list_min(p0 || p1 || p2 || p3) - 1 as first_word,
  list_max(p0 || p1 || p2 || p3) - 1 as last_word,
  coalesce(array_to_string(list_sort(list_filter([{labels}], lambda x: x is not null)), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{labels}], lambda x: x is not null) || coalesce(labels, []))), ','), '') as labels,
  case when len(p0) + len(p1) + len(p2) + len(p3) > 0 then 1.0::double else coalesce(share, 0.0)::double end as score
from placed left join more using (r)"""
