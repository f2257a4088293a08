"""Cohorts and their controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CONTROLS, POOL_CAP, TOLERANCE
from ..functions import scalars
from .sampling import reservoir


def venue_years(cohort: DataFrame) -> DataFrame:
    return cohort.select("source_id", "year").distinct()


def control_pool(works: DataFrame, cohort: DataFrame, cap: int = POOL_CAP) -> DataFrame:
    """Works of the cohort's venues and years, with references and a date, not of the cohort; at most ``cap`` of each venue and year."""
    fit = works.where((F.col("n_refs") > 0) & F.col("pub_date").isNotNull())
    pool = fit.join(venue_years(cohort), ["source_id", "year"], "left_semi").join(cohort.select("id"), "id", "left_anti")
    return reservoir(pool, ["source_id", "year"], "id", cap)


def match(cohort: DataFrame, pool: DataFrame, controls: int = CONTROLS, tolerance: float = TOLERANCE) -> DataFrame:
    """The nearest controls of each work within venue and year: those in its band of references if enough, else of all."""
    a, c = cohort.alias("a"), pool.alias("c")
    pairs = a.join(c, (F.col("a.source_id") == F.col("c.source_id")) & (F.col("a.year") == F.col("c.year"))).select(
        F.col("a.id").alias("artifact_id"),
        F.col("c.id").alias("control_id"),
        F.col("c.n_refs").alias("control_n_refs"),
        F.col("c.n_cites").alias("control_n_cites"),
        F.col("c.n_refs").between(F.col("a.n_refs") * (1 - tolerance), F.col("a.n_refs") * (1 + tolerance)).alias("in_band"),
        scalars.log_distance(F.col("c.n_refs"), F.col("a.n_refs"), F.col("c.n_cites"), F.col("a.n_cites")).alias("distance"),
    )
    of = Window.partitionBy("artifact_id")
    enough = F.count_if("in_band").over(of) >= controls
    used = pairs.withColumn("enough", enough).where(~F.col("enough") | F.col("in_band"))
    ranked = used.withColumn("n", F.row_number().over(of.orderBy(F.round("distance", 9), "control_id"))).where(F.col("n") <= controls)
    return ranked.select("artifact_id", "control_id", F.when(F.col("enough"), "venue_year").otherwise("venue_year_relaxed").alias("match_basis"), "control_n_refs", "control_n_cites")


def rate_of(events: Column, of: Column) -> Column:
    """Sum of events over sum of the denominator, per 1,000."""
    return F.sum(events) / F.nullif(F.sum(of), F.lit(0)) * 1000
