"""Profiles of prose and checks on it: each document in a row, lists of words and patterns as arguments."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import prose
from ..session import staged
from . import nearest

PROFILE = ["median_len", "sd_len", "max_len", "short_share", "long_share", "hedges", "we"]
GENRE = ["n_words", "median_len", "sd_len", "max_len", "digits"]


def profile(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sentence lengths (median, deviation, largest, shares under 13 and over 34 words), hedges and "We" per 100 words, words and digits per 100 words."""
    d = docs.withColumn("_l", prose.lengths(F.col(text))).withColumn("_n", F.size(prose.words(F.col(text))))
    d = d.withColumn("_t", F.array_remove(F.split(F.col(text), "[^A-Za-z]+"), ""))
    l, w, per = F.col("_l"), F.col("_t"), F.nullif(F.col("_n"), F.lit(0)) / 100
    return d.select(
        *docs.columns,
        F.size(l).cast("long").alias("n_sentences"),
        prose.median(l).alias("median_len"),
        prose.deviation(l).alias("sd_len"),
        F.array_max(l).alias("max_len"),
        prose.share(l, lambda n: n < 13).alias("short_share"),
        prose.share(l, lambda n: n > 34).alias("long_share"),
        (F.size(F.filter(w, lambda x: F.lower(x).isin(config.PROFILE_HEDGES))) / per).alias("hedges"),
        (F.size(F.filter(w, lambda x: x == "We")) / per).alias("we"),
        F.col("_n").cast("double").alias("n_words"),
        (F.regexp_count(F.col(text), F.lit("[0-9]")) / per).alias("digits"),
    )


def bands(profiles: DataFrame, names: list[str]) -> DataFrame:
    """One row: the least and the largest of each dimension."""
    return profiles.agg(*(F.min(n).alias(f"{n}_lo") for n in names), *(F.max(n).alias(f"{n}_hi") for n in names))


def within(profiles: DataFrame, band: DataFrame, names: list[str], slack: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """profiles with n_inside, how many dimensions lie within the band, which is one row."""
    low, high = slack
    inside = [F.when(F.col(n).between(F.col(f"{n}_lo") * low, F.col(f"{n}_hi") * high), 1).otherwise(0) for n in names]
    return profiles.crossJoin(F.broadcast(band)).withColumn("n_inside", sum(inside[1:], inside[0]).cast("long")).select(*profiles.columns, "n_inside")


def style_distances(profiles: DataFrame, corpus: DataFrame, names: list[str]) -> DataFrame:
    """Distance of each profile to the nearest of the corpus and to its centroid, in the corpus's deviations, and whether it is inside its spread and no clone.

    Inside: not farther from the centroid than the farthest of the corpus. No clone: its nearest isn't nearer than the closest two of the
    corpus. Both may be of any size: the nearest are found by cells. Nulls stand at the mean; ids are unique and not null.
    """
    stats = F.broadcast(corpus.agg(*(F.avg(n).alias(f"{n}_m") for n in names), *(F.nullif(F.stddev_pop(n), F.lit(0.0)).alias(f"{n}_s") for n in names)))

    def standard(rows: DataFrame, name: str) -> DataFrame:
        terms = (F.coalesce((F.col(n) - F.col(f"{n}_m")) / F.col(f"{n}_s"), F.lit(0.0)) for n in names)
        return staged(rows.crossJoin(stats).select(F.col("id").alias(name), F.array(*terms).alias("z")), "style")  # one row of statistics

    centroid = F.round(F.sqrt(F.aggregate("z", F.lit(0.0), lambda s, x: s + x * x)), 6)
    points, asked = standard(corpus, "point_id"), standard(profiles, "id")
    pairs = nearest.nearest(points.withColumnRenamed("point_id", "id"), points, itself=True)
    whole = points.agg(F.max(centroid).alias("widest")).crossJoin(pairs.agg(F.min("far").alias("closest")))  # single rows
    found = nearest.nearest(asked, points).withColumnRenamed("id", "_id")
    d = asked.withColumn("centroid", centroid).join(found, F.col("id") == F.col("_id"), "left").crossJoin(F.broadcast(whole))
    return d.select("id", F.col("far").alias("nearest"), F.col("point_id").alias("nearest_id"), "centroid", (F.col("centroid") <= F.col("widest")).alias("inside"), (F.col("far") >= F.col("closest")).alias("no_clone"))


def section_checks(sections: DataFrame, centre: DataFrame) -> DataFrame:
    """Each section (title, body, ...) against the limits: its median sentence near the corpus's (centre, one row of c_med), deviation, longest, adverbs, passives, vague claims."""
    d = sections.withColumn("_l", prose.lengths(F.col("body"))).crossJoin(F.broadcast(centre))
    body, l = F.col("body"), F.col("_l")
    adverbs = prose.adverbs(body, config.ADVERB, config.NO_ADVERBS_OF_SECTIONS)
    limits = {
        "median_ok": F.abs(prose.median(l) - F.col("c_med")) <= 8,
        "sd_ok": prose.deviation(l) >= 6,
        "max_ok": F.array_max(l) <= 55,
        "adverbs_ok": adverbs <= F.size(prose.words(body)) / 60,
        "passives_ok": prose.hits(body, config.PASSIVE) <= 5,
        "vague_ok": ~prose.has(body, config.VAGUE),
    }
    return d.select(*(c for c in sections.columns if c != "body"), *(v.alias(k) for k, v in limits.items()))


def word_counts(docs: DataFrame, listed: list[str], text: str = "text", exempt: str = config.EXEMPT_WORD, near: str = config.EXEMPT_NEAR) -> DataFrame:
    """A row for each document and listed word with its count as a word of its own, zeros included, outside of quotations (``so'').

    A text is cut into words once, and those that are listed are picked out by a hash set, so more words cost no more passes. What
    isn't a single run of word characters, and ``exempt``, whose places with ``near`` around them don't count, are looked for as patterns, in
    texts that have their first run.
    """
    first = {w: re.match(r"\w+", w, re.ASCII)[0].lower() for w in listed}
    plain = [w for w in listed if w.lower() == first[w] and w != exempt]
    wanted = sorted(set(first.values()))
    tokens = F.filter(F.transform(F.split(F.col("_t"), "[^A-Za-z0-9_]+"), F.lower), lambda x: x.isin(wanted))
    unquoted = F.regexp_replace(prose.plain_letters(F.col(text)), config.QUOTED, " ")
    d = docs.select("doc_id", unquoted.alias("_t")).withColumn("_hits", tokens)

    def count(word: str) -> Column:
        if word in plain:
            return F.size(F.filter("_hits", lambda x: x == first[word]))
        pattern = rf"(?i)\b{word}\b"
        if word == exempt:
            found = F.size(F.filter(contexts(F.col("_t"), pattern, len(word)), lambda c: ~F.rlike(c, F.lit(f"(?i){near}"))))
        else:
            found = F.regexp_count("_t", F.lit(pattern))
        return F.when(F.array_contains("_hits", first[word]), found).when(F.col("_t").isNotNull(), 0)

    each = F.array(*(F.struct(F.lit(w).alias("word"), count(w).cast("long").alias("n")) for w in listed))
    return d.select("doc_id", F.explode(each).alias("c")).select("doc_id", "c.word", "c.n")


def contexts(text: Column, pattern: str, size: int, before: int = config.EXEMPT_BEFORE, after: int = config.EXEMPT_AFTER) -> Column:
    """What stands around each match of a pattern, all of whose matches have the same size."""
    parts = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    places = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, lambda s, n: F.struct((s["at"] + n + size).alias("at"), F.array_append(s["found"], s["at"] + n).alias("found")))["found"]
    return F.transform(places, lambda p: F.substring(text, F.greatest(p - before, F.lit(0)) + 1, F.least(p, F.lit(before)) + after))


def pattern_hits(docs: DataFrame, patterns: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """doc_id with a boolean column for each (name, regular expression), whatever the case."""
    plain = docs.select("doc_id", prose.plain_letters(F.col(text)).alias("_t"))
    return plain.select("doc_id", *(F.rlike("_t", F.lit(f"(?is){p}")).alias(name) for name, p in patterns))


def provenance(docs: DataFrame, results: DataFrame, text: str = "text", at_once: int = 1000) -> DataFrame:
    """doc_id, name and found: whether each formatted result value (name, said) occurs in each text, some ``at_once`` results to a row, however many there are."""
    lists = max(1, -(-results.count() // at_once))
    each = results.withColumn("_list", F.pmod(F.xxhash64("name", "said"), F.lit(lists)).cast("int"))
    listed = each.groupBy("_list").agg(F.collect_list(F.struct("name", "said")).alias("_results"))
    d = docs.select("doc_id", F.col(text).alias("_text"), F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("_list"))
    d = d.join(listed, "_list").withColumn("_r", F.explode("_results"))
    return d.select("doc_id", "_r.name", F.contains(F.col("_text"), F.col("_r.said")).alias("found"))


def rubric(terms: list[tuple[Column, float, float]]) -> Column:
    """Weighted sum of (score, cap, weight)."""
    parts = [F.least(score.cast("double"), F.lit(float(cap))) * weight for score, cap, weight in terms]
    return sum(parts[1:], parts[0])


def has_run(lengths: Column, below: float, size: int = 3) -> Column:
    """Whether so many lengths in a row are below a bound."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("longest"))

    def step(state: Column, n: Column) -> Column:
        run = F.when(n < below, state["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(state["longest"], run).alias("longest"))

    return F.aggregate(lengths, start, step)["longest"] >= size
