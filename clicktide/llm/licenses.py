"""License notices found by voting of word k-grams for the diagonals of templates."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clicktide.llm.text import NOT_ALNUM, WORD_BASE, Slice, Spans, measured, slices

GRAM = 3
# Diagonals at most so many words apart belong to one span: words may be added or left out there.
BAND = 16
# Share of a template's k-grams that a span must hold.
COVERED = 0.6
# Of a template with numbers, as in "version 3", a span must hold a k-gram with a number.
NUMBER = re.compile(r"\b[0-9]+\b")

# Phrases that count wherever their words stand next to each other.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Sentences of public licenses and of the notices that refer to them, with labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-2",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}


# Whole texts of short public licenses, or of their second halves, with labels.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the software the software is "
    "provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
    "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
    "arising from out of or in connection with the software or the use or other dealings in the software": "mit",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and "
    "the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all "
    "implied warranties of merchantability and fitness in no event shall the author be liable for any special direct "
    "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in "
    "an action of contract negligence or other tortious action arising out of or in connection with the use or "
    "performance of this software": "isc",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or "
    "as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
}


def numbers(words: str) -> list[int]:
    """Places of the k-grams of a template that have a number; all places if none has."""
    w = words.split()
    grams = [" ".join(w[i : i + GRAM]) for i in range(len(w) - GRAM + 1)]
    return [i for i, g in enumerate(grams) if NUMBER.search(g)] or list(range(len(grams)))


# The one position of every document that each document votes for, so that none is lost.
EVERY = -1


def templates() -> list[tuple[int, str, str, bool]]:
    """`(number, words, label, whether it is a phrase)`."""
    both = [(w, label, True) for w, label in PHRASES.items()]
    both += [(w, label, False) for w, label in (*NOTICES.items(), *TEXTS.items())]
    return [(i, *t) for i, t in enumerate(both)]


def _grams(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-gram, bounds of each document's)."""
    at = part.windows(GRAM)
    hashes = Spans(part.word_hashes(), WORD_BASE).hashes(at, at + GRAM).view(np.int64)
    return hashes, np.searchsorted(at, part.word_bounds)


def positions(spark: SparkSession) -> DataFrame:
    """`(gram, template, at)`: every k-gram of every template; a table of fixed size."""
    rows = [(0, EVERY, 0)]
    for i, words, _, _ in templates():
        (part,) = slices(pa.array([words]), NOT_ALNUM)
        grams = _grams(part)[0].tolist()
        rows += [(gram, i, at) for at, gram in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template int, at int")


def _measure(part: Slice) -> list:
    hashes, bounds = _grams(part)
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes))
    return [np.diff(part.word_bounds), lists]


def _by_template(values: list) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), F.col("template") + 1)


def spans(docs: DataFrame) -> DataFrame:
    """`(_row, doc_id, n_words, template, first, last, covered, numbered, exact)`: merged diagonals with votes.

    All k-grams of all documents meet the templates' in a map-side join. A diagonal is the place in
    the document minus the place in the template; votes on it are the template's k-grams that
    the document has there. Diagonals up to BAND apart are merged. `covered` is the share of the
    template's k-grams found, `exact` the number of diagonals on which all were found; `first` and
    `last` are the least and largest diagonal of those that have all votes, if any. Template
    EVERY comes once for each document.
    """
    fields = [("n_words", "long"), ("grams", "array<long>")]
    rows = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    grams = measured(rows, fields, _measure, separator=NOT_ALNUM, lower=True, drop=("text",))
    # The gram before the first one stands for the document itself.
    every = F.concat(F.array(F.lit(0).cast("long")), F.col("grams"))
    each = grams.select("_row", "doc_id", "n_words", F.posexplode(every).alias("place", "_gram"))
    known = positions(docs.sparkSession)
    votes = each.join(F.broadcast(known), F.col("_gram") == F.col("gram")).filter(
        (F.col("place") > 0) == (F.col("template") != EVERY)
    )
    diagonal = F.col("place") - 1 - F.col("at")
    places = F.collect_set("at").alias("places")
    lines = votes.groupBy("_row", "template", diagonal.alias("diagonal")).agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), places
    )
    along = Window.partitionBy("_row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > BAND
    merged = lines.withColumn("_new", F.coalesce(apart, F.lit(False)).cast("int"))
    merged = merged.withColumn("_span", F.sum("_new").over(along))
    sizes = [len(words.split()) - GRAM + 1 for _, words, _, _ in templates()]
    size = F.when(F.col("template") == EVERY, 1).otherwise(_by_template(sizes))
    whole = F.when(F.size("places") == size, F.col("diagonal"))
    numbered = F.array(*(F.array(*map(F.lit, numbers(t[1]))) for t in templates()))
    number = F.when(F.col("template") == EVERY, F.array(F.lit(0))).otherwise(F.element_at(numbered, F.col("template") + 1))
    # As a set, a span's places are those of the template at most, however often a document repeats it.
    found = F.array_distinct(F.flatten(F.collect_list("places")))
    spans = merged.groupBy("_row", "template", "_span").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.min(whole).alias("first"),
        F.max(whole).alias("last"),
        found.alias("_places"),
        F.first(size).alias("_size"),
        F.count(whole).alias("exact"),
    )
    return spans.withColumns(
        {"covered": F.size("_places") / F.col("_size"), "numbered": F.arrays_overlap("_places", number)}
    ).drop("_places", "_size")


def scan(docs: DataFrame) -> DataFrame:
    """`(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)` per row.

    `n_base` counts the places where all words of one of PHRASES stand consecutively, and
    `base_labels` are theirs. `labels` has besides the labels of spans that hold at least COVERED
    of a template's k-grams, and a number of it if it has one. `score` is the largest share found. Words are compared by 64-bit hashes.

    Null and empty texts have no words: 0, null, empty labels, score 0. Repeated rows get a row
    each, a null doc_id is kept. An empty table gives an empty table. Columns other than doc_id and
    text are ignored.
    """
    known = templates()
    label = _by_template([t[2] for t in known])
    phrase = (F.col("template") != EVERY) & _by_template([t[3] for t in known])
    close = (F.col("covered") >= COVERED) & F.col("numbered")
    any_label = (F.col("template") != EVERY) & (close | (F.col("exact") > 0))
    base = phrase & (F.col("exact") > 0)
    found = spans(docs).withColumns({"_label": F.when(F.col("template") != EVERY, label)})
    names = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("_label")))), ",")
    return found.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.sum(F.when(base, F.col("exact")).otherwise(0)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(any_label & (~phrase | base)).alias("labels"),
        F.max(F.when(F.col("template") != EVERY, F.col("covered")).otherwise(0.0)).alias("score"),
    ).drop("_row")


def op10_licenses(spark, sf: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf}/documents.parquet"))


def _sql_templates() -> str:
    rows = []
    for i, words, label, phrase in templates():
        w = words.split()
        grams = [" ".join(w[j : j + GRAM]) for j in range(len(w) - GRAM + 1)]
        rows += [f"({i}, {at}, '{g}', '{label}', {phrase}, {len(grams)}, {at in numbers(words)})" for at, g in enumerate(grams)]
    return ", ".join(rows)


OP10_SQL = f"""
WITH t(template, pos, gram, label, phrase, size, number) AS (VALUES {_sql_templates()}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS l FROM documents),
w AS (SELECT r, unnest(l) AS word, unnest(range(0, len(l))) AS i FROM d),
g AS (SELECT r, i, word || ' ' || lead(word) OVER q || ' ' || lead(word, 2) OVER q AS gram
      FROM w WINDOW q AS (PARTITION BY r ORDER BY i)),
v AS (SELECT r, template, label, phrase, size, i - pos AS diagonal, count(*) AS votes,
             list(pos) AS places, bool_or(number) AS number
      FROM g JOIN t USING (gram) GROUP BY r, template, label, phrase, size, i - pos),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS span
      FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {BAND}
                           THEN 1 ELSE 0 END AS fresh FROM v)),
m AS (SELECT r, template, label, phrase, min(CASE WHEN votes = size THEN diagonal END) AS first,
             max(CASE WHEN votes = size THEN diagonal END) AS last,
             count(CASE WHEN votes = size THEN 1 END) AS exact,
             len(list_distinct(flatten(list(places)))) / CAST(size AS DOUBLE) AS covered, bool_or(number) AS numbered
      FROM s GROUP BY r, template, label, phrase, size, span),
f AS (SELECT r, CAST(sum(CASE WHEN phrase THEN exact ELSE 0 END) AS BIGINT) AS n_base,
             min(CASE WHEN phrase THEN first END) AS first_word, max(CASE WHEN phrase THEN last END) AS last_word,
             list_sort(list(DISTINCT label) FILTER (phrase AND exact > 0)) AS b,
             list_sort(list(DISTINCT label) FILTER ((NOT phrase AND covered >= {COVERED} AND numbered) OR exact > 0)) AS a,
             max(covered) AS score FROM m GROUP BY r)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(b, ','), '') AS base_labels, coalesce(array_to_string(a, ','), '') AS labels,
       coalesce(score, 0.0) AS score
FROM d LEFT JOIN f USING (r)"""
