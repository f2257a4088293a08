"""License scans by diagonal voting, in DataFrame operations only.

All rolling word k-grams of the texts are hashed and joined to the positions of the same
k-grams in license templates; the words themselves are compared too. A hit at word p of
the text and word q of the template votes for the diagonal p - q. Votes are aggregated by
document, template and diagonal, as a bit for each template position; diagonals at most
``SLACK`` apart are merged, as words put in or left out shift them. A merged diagonal
that covers enough of its template is a verified span. A base phrase is a template too:
its places are the diagonals on which every position voted.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. Nulls count
as empty: no words, no labels, score 0. Rows are told apart by doc_id and text; repeated
rows give a row each. Only the templates, a constant, are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii

GRAM, SLACK, COVERAGE = 3, 2, 0.6
#: Template positions fit a long.
MOST_GRAMS = 62
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases, then notices of common licenses, with their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("cc0 1 0 universal public domain dedication", "cc0"),
]


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    base: bool

    @property
    def grams(self) -> int:
        return len(self.words) - GRAM + 1


def templates() -> list[Template]:
    made = [Template(tuple(phrase.split(" ")), label, base) for group, base in ((BASE, True), (NOTICES, False)) for phrase, label in group]
    if any(not 1 <= t.grams <= MOST_GRAMS for t in made):
        raise ValueError(f"a template has {GRAM} to {MOST_GRAMS + GRAM - 1} words")
    return made


def template_grams(spark: SparkSession, of: list[Template]) -> DataFrame:
    """A row for each k-gram position: at most MOST_GRAMS for each template."""
    rows = [(n, q, *t.words[q : q + GRAM]) for n, t in enumerate(of) for q in range(t.grams)]
    names = [f"t{i}" for i in range(GRAM)]
    table = spark.createDataFrame(rows, "template int, q int, " + ", ".join(f"{n} string" for n in names))
    return table.withColumn("hash", F.xxhash64(*names))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), "")


def diagonals(docs: DataFrame, of: list[Template]) -> DataFrame:
    """Votes: (doc_id, key, n_words, template, diagonal, votes, rows), votes a bit mask of template positions.

    Every document has a row at least, with null template where its words hit nothing;
    the largest of its rows is how often (doc_id, text) occurs, as the
    first word is in one group at least and in each once an occurrence. One pass over the texts; only
    aggregated votes are shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), words(F.col("text")).alias("w"))
    split = split.withColumn("n_words", F.size("w").cast("long"))
    shifted = [F.col("w").alias("w0"), *(F.slice("w", i + 1, F.greatest(F.size("w"), F.lit(1))).alias(f"w{i}") for i in range(1, GRAM))]
    grams = split.select("doc_id", "key", "n_words", *shifted)
    grams = grams.select("doc_id", "key", "n_words", F.posexplode_outer(F.arrays_zip(*(f"w{i}" for i in range(GRAM)))).alias("p", "g"))
    grams = grams.select("doc_id", "key", "n_words", "p", *(F.col(f"g.w{i}").alias(f"w{i}") for i in range(GRAM)))
    grams = grams.withColumn("hash", F.when(F.col(f"w{GRAM - 1}").isNotNull(), F.xxhash64(*(f"w{i}" for i in range(GRAM)))))
    table = F.broadcast(template_grams(docs.sparkSession, of)).alias("t")
    same = F.col("g.hash") == F.col("t.hash")
    for i in range(GRAM):
        same &= F.col(f"w{i}") == F.col(f"t{i}")
    hits = grams.alias("g").join(table, same, "left")
    return hits.groupBy("doc_id", "key", "n_words", "template", (F.col("p") - F.col("q")).cast("long").alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, q)")).alias("votes"),
        F.sum(F.when(F.coalesce("p", F.lit(0)) == 0, 1).otherwise(0)).alias("rows"),
    )


def described(spark: SparkSession, of: list[Template]) -> DataFrame:
    rows = [(n, t.label, t.base, t.grams, (1 << t.grams) - 1) for n, t in enumerate(of)]
    return F.broadcast(spark.createDataFrame(rows, "template int, label string, base boolean, grams int, full_votes long"))


def merged(votes: DataFrame, of: list[Template]) -> DataFrame:
    """Neighbouring diagonals of a document and template as one row, with the share of the template's positions that voted.

    Diagonals of base phrases aren't merged: those count only where every position voted.
    """
    named = votes.join(described(votes.sparkSession, of), "template", "left")
    order = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK)
    numbered = named.withColumn("apart", F.when(apart, 1).otherwise(0)).withColumn("run", F.sum("apart").over(order))
    spans = numbered.groupBy("doc_id", "key", "n_words", "template", "label", "base", "grams", "run").agg(
        F.min("diagonal").alias("start"), F.bit_or("votes").alias("votes"), F.max("rows").alias("rows")
    )
    return spans.withColumn("coverage", F.coalesce(F.bit_count("votes") / F.col("grams"), F.lit(0.0)))


def verified() -> Column:
    return F.col("template").isNotNull() & (F.col("coverage") >= F.when(F.col("base"), 1.0).otherwise(COVERAGE))


def spans(docs: DataFrame) -> DataFrame:
    """Verified spans: doc_id, label, base, start (a word; below 0 if the template's start is cut off), coverage."""
    of = templates()
    return merged(diagonals(docs, of), of).where(verified()).select("doc_id", "label", "base", "start", "coverage")


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: counts and places of base phrases, labels, and the best coverage as score."""
    of = templates()
    base = F.col("found") & F.col("base")

    def joined(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    found = merged(diagonals(docs, of), of).withColumn("found", verified())
    out = found.groupBy("doc_id", "key", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("found")).alias("labels"),
        F.max(F.when(F.col("found"), F.col("coverage")).otherwise(0.0)).alias("score"),
        F.max("rows").cast("int").alias("rows"),
    )
    return out.withColumn("row", F.explode(F.array_repeat(F.lit(1), F.col("rows")))).drop("key", "rows", "row")


def oracle() -> str:
    """DuckDB SQL for scan() over the table documents."""
    of = templates()
    rows = ", ".join(f"({n}, '{t.label}', {str(t.base).lower()}, {list(t.words)!r})" for n, t in enumerate(of))
    return rf"""
WITH t(template, label, base, w) AS (VALUES {rows}),
tg AS (SELECT template, label, base, len(w) - {GRAM - 1} AS grams, q - 1 AS q, w[q] AS a, w[q + 1] AS b, w[q + 2] AS c
       FROM (SELECT *, unnest(range(1, len(w) - {GRAM - 2})) AS q FROM t)),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NOT_WORD}'), lambda x: x <> '') AS w
      FROM documents),
g AS (SELECT rid, p - 1 AS p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - {GRAM - 2})) AS p FROM d)),
v AS (SELECT rid, template, label, base, grams, p - q AS diagonal, bit_or(1::BIGINT << q) AS votes FROM g JOIN tg USING (a, b, c) GROUP BY ALL),
r AS (SELECT *, sum(CASE WHEN base OR diagonal - prior > {SLACK} THEN 1 ELSE 0 END) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run
      FROM (SELECT *, lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) AS prior FROM v)),
s AS (SELECT rid, template, label, base, run, min(diagonal) AS start, bit_count(bit_or(votes)) / grams::DOUBLE AS coverage FROM r GROUP BY rid, template, label, base, grams, run),
f AS (SELECT * FROM s WHERE coverage >= CASE WHEN base THEN 1.0 ELSE {COVERAGE} END)
SELECT doc_id, len(any_value(w))::BIGINT AS n_words, count(*) FILTER (f.base)::BIGINT AS n_base,
       min(start) FILTER (f.base)::BIGINT AS first_word, max(start) FILTER (f.base)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (f.base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (label IS NOT NULL), '') AS labels,
       coalesce(max(coverage), 0.0)::DOUBLE AS score
FROM d LEFT JOIN f USING (rid) GROUP BY rid, doc_id"""
