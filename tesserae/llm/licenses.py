"""License scans by diagonal voting (DataFrame functions only).

All rolling two-word hashes of every text are joined to the positions of the same hashes in a small
set of license templates.  A hit at text word p and template word q votes for the diagonal p - q; a
copy of a template piles its votes on one diagonal, and an insertion or deletion moves the rest to a
neighbouring one, so neighbouring diagonals are merged.  A span is reported after verification: the
words themselves are compared at every hit, and enough of the template must be covered.

The base phrases are templates of their own, for which one diagonal must hold every word.  Of the
longer templates only positions with a word of ``LONG`` letters or more vote and count for the
coverage: pairs such as "of the" are in every text and in every license.

The text is split once: each row also emits one mark with its word count, which joins to a position
of its own and so carries the count, and the number of equal rows, through the same aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False


BASE = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)
NOTICES = (
    Template("mit-notice", "released under the mit license"),
    Template("apache-2.0-notice", "licensed under the apache license version 2 0"),
    Template("gpl-3.0-notice", "this work is licensed under the gnu general public license version 3"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("cc-by-4.0", "licensed under the creative commons attribution 4 0 international license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
)
#: The wording of public licenses, in lower case and without punctuation.
BODIES = (
    Template(
        "mit-body",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    Template(
        "isc-body",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with "
        "regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special "
        "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    Template(
        "bsd-2-body",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is "
        "and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
        "purpose are disclaimed",
    ),
    Template(
        "apache-2.0-body",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
        "specific language governing permissions and limitations under the license",
    ),
    Template(
        "gpl-body",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it "
        "will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
        "general public license for more details",
    ),
    Template(
        "unlicense-body",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute "
        "this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
)
TEMPLATES = BASE + NOTICES + BODIES
LONG = 5  # letters
SHORT = 24  # words of a template of which every pair votes


def positions(templates: tuple[Template, ...]) -> list[tuple[int, int, str, str]]:
    """(template, place, word, next word) of every pair that votes."""
    out = []
    for i, t in enumerate(templates):
        w = t.text.split(" ")
        long = len(w) > SHORT
        out += [(i, q, a, b) for q, (a, b) in enumerate(zip(w, w[1:])) if not long or max(len(a), len(b)) >= LONG]
    return out


def voting(templates: tuple[Template, ...]) -> list[int]:
    """How many pairs of each template vote."""
    of = [i for i, *_ in positions(templates)]
    return [of.count(i) for i in range(len(templates))]


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def _positions(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """One row for each pair of a template that votes, and the mark (template -1).  The templates are code, so this is bounded: some hundred rows."""
    quoted = ", ".join(f"({i}, {q}, '{a}', '{b}')" for i, q, a, b in [*positions(templates), (-1, 0, "", "")])
    return spark.sql(f"SELECT t, q, a, b, xxhash64(a, b) AS h FROM VALUES {quoted} AS v(t, q, a, b)")


def _lookup(values: list, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), key + 1)


def _spans(docs: DataFrame, templates: tuple[Template, ...], coverage: float, drift: int) -> DataFrame:
    """``doc_id, text_hash, t, lo, hi, coverage, copies``: the spans found, and a row with t = -1 for each text, whose lo is its word count."""
    w = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    # words that begin or end no pair of a template cannot join, and are left out before the explode
    first, second = (sorted({x[k] for x in positions(templates)}) for k in (2, 3))
    at = F.array_compact(F.transform("w", lambda x, i: F.when(x.isin(first) & F.get("w", i + 1).isin(second), i)))
    pair = F.transform(at, lambda i: F.struct(i.alias("p"), F.get("w", i).alias("a"), F.get("w", i + 1).alias("b")))
    mark = F.struct(F.size("w").alias("p"), F.lit("").alias("a"), F.lit("").alias("b"))
    rolled = w.select("doc_id", "text_hash", F.explode(F.concat(pair, F.array(mark))).alias("g"))
    rolled = rolled.select("doc_id", "text_hash", F.col("g.p").alias("p"), F.xxhash64("g.a", "g.b").alias("g_h"), F.col("g.a").alias("g_a"), F.col("g.b").alias("g_b"))
    pos = F.broadcast(_positions(docs.sparkSession, templates))
    hits = rolled.join(pos, (F.col("g_h") == F.col("h")) & (F.col("g_a") == F.col("a")) & (F.col("g_b") == F.col("b")))

    # votes: each (text position, template position) once, so repeated rows do not count twice
    votes = hits.groupBy("doc_id", "text_hash", "t", (F.col("p") - F.col("q")).alias("diagonal")).agg(
        F.collect_set(F.struct(F.col("p").cast("bigint").alias("p"), "q")).alias("v"), F.count("*").alias("copies")
    )
    votes = votes.select(
        "doc_id", "text_hash", "t", "diagonal", "copies", F.array_min("v.p").alias("lo"), (F.array_max("v.p") + 1).alias("hi"), F.array_distinct("v.q").alias("q"),
        F.coalesce(_lookup([t.text.count(" ") for t in templates], F.greatest("t", F.lit(0))), F.lit(0)).alias("length"),
    )
    # base phrases and the mark keep to one diagonal; neighbouring diagonals of the others are one span
    alone = (F.col("t") < 0) | _lookup([t.base for t in templates], F.greatest("t", F.lit(0)))
    by = Window.partitionBy("doc_id", "text_hash", "t").orderBy("diagonal")
    new = alone | (F.col("diagonal") - F.lag("diagonal").over(by) > drift) | (F.col("lo") - F.lag("hi").over(by) > F.col("length"))
    votes = votes.withColumn("span", F.sum(F.when(new, 1).otherwise(0)).over(by))
    spans = votes.groupBy("doc_id", "text_hash", "t", "span").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.size(F.array_distinct(F.flatten(F.collect_list("q")))).alias("n"), F.max("copies").alias("copies"), F.first(alone).alias("alone"),
    )
    share = F.when(F.col("t") < 0, 1.0).otherwise(F.col("n") / _lookup(voting(templates), F.greatest("t", F.lit(0))))
    return spans.withColumn("coverage", share).where(F.col("coverage") >= F.when(F.col("alone"), 1.0).otherwise(coverage)).drop("alone", "n", "span")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, coverage: float = 0.75, drift: int = 3) -> DataFrame:
    """``doc_id, text_hash, label, base, first_word, last_word, coverage``: one row for each span found.

    Spans of base templates need every word on one diagonal.  Others merge diagonals at most
    ``drift`` apart whose hits also follow each other within a template's length, and need
    ``coverage`` of the template's voting pairs.

    Rows with equal doc_id and text count once; null texts have no words; null doc_ids are kept;
    other columns are not read; an empty table gives no spans.  Very long texts stream through an
    explode; nothing is gathered but the hits.
    """
    found = _spans(docs, templates, coverage, drift).where("t >= 0")
    return found.select(
        "doc_id", "text_hash", _lookup([t.label for t in templates], F.col("t")).alias("label"), _lookup([t.base for t in templates], F.col("t")).alias("base"),
        F.col("lo").alias("first_word"), F.col("hi").alias("last_word"), "coverage",
    )


def summarize(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, coverage: float = 0.75, drift: int = 3) -> DataFrame:
    """One row for each row of ``docs``: word count, base places, labels and the best coverage.

    Edge cases are those of :func:`scan`; a repeated row gives a repeated result, and a text without
    words or spans has counts of 0, empty labels and no places.
    """
    spans = _spans(docs, templates, coverage, drift)
    t = F.greatest("t", F.lit(0))
    found = F.col("t") >= 0
    base, label = found & _lookup([x.base for x in templates], t), _lookup([x.label for x in templates], t)
    per = spans.groupBy("doc_id", "text_hash").agg(
        F.max(F.when(~found, F.col("lo"))).alias("n_words"),
        F.max(F.when(~found, F.col("copies"))).alias("copies"),
        F.sum(base.cast("bigint")).alias("n_base"),
        F.min(F.when(base, F.col("lo"))).alias("first_word"),
        F.max(F.when(base, F.col("lo"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, label))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(found, label))), ",").alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("coverage"))), F.lit(0.0)).alias("score"),
    )
    rows = per.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
