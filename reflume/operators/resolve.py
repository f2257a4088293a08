"""Resolving references against a table of known works."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import FUZZY_LEAST


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def similarity(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence over both lengths."""
    return 100.0 * 2 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def sorted_tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def best_window(a: str, b: str) -> float:
    """The best similarity of the shorter text to any part of the longer of its length, cut-off parts at the ends included."""
    short, long_ = sorted((a, b), key=len)
    n = len(short)
    if not n:
        return 100.0 if not long_ else 0.0
    return max(similarity(short, long_[max(0, i) : i + n]) for i in range(1 - n, len(long_)))


def title_score(a: str | None, b: str | None) -> float:
    """The better of token-sorted similarity and of best_window, in lower case; 0 for nulls."""
    if a is None or b is None:
        return 0.0
    a, b = a.lower(), b.lower()
    return max(similarity(sorted_tokens(a), sorted_tokens(b)), best_window(a, b))


@F.pandas_udf(T.DoubleType())
def title_scores(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([title_score(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def fuzzy_match(references: DataFrame, known: DataFrame, least: float = FUZZY_LEAST) -> DataFrame:
    """ref_id, known_id and score of the best known title for each reference, of those with one of its rarer words; null where none scores enough.

    Rarer are the half of a title's distinct words that fewest known titles have (two at least, ties by the word), so a word that
    many titles share brings no pairs together unless a reference has none but such.
    """
    word = F.explode(F.array_distinct(F.split(F.lower("title"), r"\s+")))
    of_known = known.select("known_id", word.alias("word"))
    often = of_known.groupBy("word").agg(F.count("*").alias("often"))
    mine = Window.partitionBy("ref_id")
    ranked = references.select("ref_id", word.alias("word")).join(often, "word").withColumn("n", F.row_number().over(mine.orderBy("often", "word"))).withColumn("size", F.count("*").over(mine))
    rare = ranked.where(F.col("n") <= F.greatest(F.lit(2), F.ceil(F.col("size") / 2))).select("ref_id", "word")
    pairs = rare.join(of_known, "word").select("ref_id", "known_id").distinct()
    scored = pairs.join(references, "ref_id").withColumnRenamed("title", "a").join(known.withColumnRenamed("title", "b"), "known_id")
    scored = scored.withColumn("score", title_scores("a", "b"))
    best = scored.groupBy("ref_id").agg(F.min(F.struct((-F.col("score")).alias("less"), "known_id")).alias("m")).select("ref_id", "m.known_id", (-F.col("m.less")).alias("score")).where(F.col("score") >= least)
    return references.join(best, "ref_id", "left").select("ref_id", "known_id", "score")


def unresolvable(rows: DataFrame, known: DataFrame, shortest: int = 15) -> DataFrame:
    """rows (id, doi, title) with unresolvable: a DOI that isn't known, or, without a DOI, a title of ``shortest`` characters or more that no known work has.

    Titles are compared in lower case; shorter ones and missing ones are treated as resolvable, the cautious direction.
    """
    title = F.lower(F.trim("title"))
    by_doi = looked_up(rows.where("doi is not null"), "doi", known.select("doi"))
    rest = rows.where("doi is null").withColumn("_key", F.when(F.length(F.trim("title")) >= shortest, title))
    by_title = looked_up(rest, "_key", known.select(title.alias("_key"))).withColumn("resolves", F.col("resolves") | F.col("_key").isNull())
    return by_doi.unionByName(by_title.drop("_key")).withColumn("unresolvable", ~F.col("resolves")).drop("resolves")


def looked_up(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """rows with resolves: each distinct key is looked up once and joined back; a null key doesn't resolve."""
    found = rows.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key).distinct(), key, "left_semi").withColumn("resolves", F.lit(True))
    return rows.join(found, key, "left").withColumn("resolves", F.coalesce("resolves", F.lit(False)))
