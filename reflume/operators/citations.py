"""Late references: references to works that were retracted and eligible when the citing work appeared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars


def clean_retractions(events: DataFrame) -> DataFrame:
    """True retractions with a usable DOI and date, the earliest of each DOI; ties go to the smaller record."""
    d = _checked(events).where((F.col("nature_ok")) & (F.col("doi_ok")) & F.col("retraction_date").isNotNull())
    order = Window.partitionBy("ndoi").orderBy("retraction_date", "record_id")
    first = d.withColumn("n", F.row_number().over(order)).where("n = 1")
    return first.select("record_id", F.col("ndoi").alias("doi"), "retraction_date", scalars.clean_reason(F.col("reason")).alias("reason"), F.trim("journal").alias("journal"))


def retraction_skips(events: DataFrame) -> DataFrame:
    """Counts of what clean_retractions leaves out, by the first rule that fails."""
    d = _checked(events)
    ok, doi = F.col("nature_ok"), F.col("doi_ok")
    dated = F.col("retraction_date").isNotNull()
    return d.agg(F.count_if(~ok).alias("nature"), F.count_if(ok & ~doi).alias("no_doi"), F.count_if(ok & doi & ~dated).alias("no_date"), F.count_if(ok & doi & dated).alias("kept"))


def _checked(events: DataFrame) -> DataFrame:
    d = events.withColumn("ndoi", scalars.norm_doi(F.col("doi"))).withColumn("retraction_date", scalars.parse_date(F.col("retracted")))
    d = d.withColumn("nature_ok", F.coalesce(F.trim("nature") == "Retraction", F.lit(False)))
    return d.withColumn("doi_ok", F.col("ndoi").isNotNull() & ~F.coalesce(F.contains("ndoi", F.lit("unavailable")), F.lit(False)))


def late_counts(works: DataFrame, references: DataFrame, targets: DataFrame) -> DataFrame:
    """works with late, the number of references to eligible targets; repeated references count each.

    Only edges to targets are kept before they meet the works; counts are aggregated by
    work before they are joined, so n_refs isn't multiplied. targets are unique by id.
    """
    hits = references.join(targets.withColumnRenamed("id", "ref"), "ref").join(works.select("id", "pub_date"), "id")
    late = hits.where(F.col("pub_date") >= F.col("eligible")).groupBy("id").agg(F.count("*").alias("late"))
    return works.join(late, "id", "left").withColumn("late", F.coalesce("late", F.lit(0)))


def late_counts_of_lists(works: DataFrame, targets: DataFrame, refs: str = "refs") -> DataFrame:
    """late_counts for works that hold their references in an array column; null arrays count 0."""
    return late_counts(works, works.select("id", F.explode(refs).alias("ref")), targets)


def series(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Late references, references, works and the rate per 10,000 by the keys."""
    d = counted.groupBy(*keys).agg(F.sum("late").alias("events"), F.sum("n_refs").alias("refs"), F.count("*").alias("works"))
    return d.withColumn("rate", F.round(scalars.rate(F.col("events"), F.col("refs")), 6))


def series_and_pooled(counted: DataFrame) -> DataFrame:
    """series by month and field, and pooled over fields (null field), in one aggregation."""
    d = counted.groupingSets([["month", "field"], ["month"]], "month", "field").agg(F.sum("late").alias("events"), F.sum("n_refs").alias("refs"))
    return d.withColumn("rate", F.round(scalars.rate(F.col("events"), F.col("refs")), 6))


def month_spine(spark, first: str, last: str) -> DataFrame:
    """Every month from first to last."""
    days = F.explode(F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last}-01")), F.expr("INTERVAL 1 MONTH")))
    return spark.range(1).select(days.alias("day")).select(scalars.month_of(F.col("day")).alias("month"))


def on_spine(pooled: DataFrame, spine: DataFrame) -> DataFrame:
    """The series on every month of the spine; months without works have a null rate."""
    return spine.join(pooled, "month", "left")


def doi_map(works: DataFrame, retracted: DataFrame) -> DataFrame:
    """Works whose DOI is a retracted one, with the event's columns; one row for each (doi, id)."""
    named = works.select("id", scalars.norm_doi(F.col("doi")).alias("doi")).where("doi is not null").distinct()
    return retracted.join(named, "doi")
