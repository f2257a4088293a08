"""The rules that keep or drop a phrase hit, first match first, and what they say of the phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ERA_YEAR, KEPT_TYPES, META_SUBFIELDS, META_TERMS, META_TITLE, PHRASES
from ..functions import scalars


def meta_hits(abstract: Column, terms: list[str] = META_TERMS) -> Column:
    """The listed terms that occur, in the list's order."""
    text = F.lower(F.replace(F.coalesce(abstract, F.lit("")), F.lit("\u0130"), F.lit("i")))  # Spark makes two code points of this one, SQL an i
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def reason(era: int = ERA_YEAR, uncounted: bool = False) -> Column:
    """kept, or why not. A missing year is treated as one before the era, a missing count of references as none unless uncounted ones may be kept."""
    hits = meta_hits(F.col("abstract"))
    return (
        F.when(~F.coalesce(F.col("phrase").isin(PHRASES), F.lit(False)), "phrase_retired")
        .when(F.col("year").isNull() | (F.col("year") < era), "pre_chatgpt")
        .when(scalars.short_id(F.col("subfield")).isin(META_SUBFIELDS), "ai_subfield")
        .when(F.coalesce(F.rlike(F.col("title"), F.lit(f"(?i){scalars.ascii_bounds(META_TITLE)}")), F.lit(False)), "meta_title")
        .when(F.size(hits) >= 2, F.concat(F.lit("meta_abstract:"), F.array_join(F.slice(hits, 1, 3), "|")))
        .when(~F.coalesce(F.col("type").isin(KEPT_TYPES), F.lit(False)), F.concat(F.lit("type:"), F.coalesce("type", F.lit("None"))))
        .when(F.coalesce("n_refs", F.lit(1 if uncounted else 0)) == 0, "no_references")
        .otherwise("kept")
    )


def classify(candidates: DataFrame, uncounted: bool = False) -> DataFrame:
    return candidates.withColumn("reason", reason(uncounted=uncounted)).withColumn("keep", F.col("reason") == "kept")


def first_hits(candidates: DataFrame, phrases: list[str] = PHRASES) -> DataFrame:
    """One row for each id: that of the phrase which comes first in the registry, unknown phrases last."""
    place = F.array_position(F.array(*map(F.lit, phrases)), F.col("phrase"))
    order = Window.partitionBy("id").orderBy(F.when(place == 0, len(phrases) + 1).otherwise(place), "phrase")
    return candidates.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def phrase_validation(candidates: DataFrame, era: int = ERA_YEAR) -> DataFrame:
    """Hits by phrase, and the share from before the era, all of which are false."""
    d = candidates.where("year is not null").groupBy("phrase").agg(F.count("*").alias("n_hits"), F.count_if(F.col("year") < era).alias("n_pre"))
    return d.select("phrase", "n_hits", "n_pre", F.round(F.col("n_pre") / F.col("n_hits"), 4).alias("false_positive_rate"), (F.col("n_hits") - F.col("n_pre")).alias("n_post"), (~F.col("phrase").isin(PHRASES)).alias("retired"))


def harvest(texts: DataFrame, phrases: list[str], text: str = "text") -> DataFrame:
    """A row for each text and phrase that occurs in it, whatever the case; the phrases, a short list, are tried within the row."""
    low = F.lower(F.col(text))
    found = F.filter(F.array(*(F.lit(p) for p in phrases)), lambda p: F.contains(low, F.lower(p)))
    return texts.withColumn("phrase", F.explode(found))
