"""Queries on late references: counts, monthly series, targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import citations
from ..session import shared_path
from ..sources import layout, standins
from ..sources.standins import SQL
from ..streaming.totals import Totals
from .queries import query


def counted(spark: SparkSession, d: str) -> DataFrame:
    return citations.late_counts(standins.works(spark, d), standins.references(spark, d), standins.targets(spark, d))


@query(SQL + """SELECT month, field, sum(late)::BIGINT AS events, sum(n_refs)::BIGINT AS refs, count(*) AS works,
round(CASE WHEN sum(n_refs) > 0 THEN sum(late)::DOUBLE / sum(n_refs) * 10000 END, 6) AS rate FROM counted GROUP BY 1, 2""")
def population_series(spark: SparkSession, d: str) -> DataFrame:
    return citations.series(counted(spark, d), ["month", "field"])


@query(SQL + "SELECT month, field, sum(late)::BIGINT AS events, sum(n_refs)::BIGINT AS refs, count(*) AS works FROM counted WHERE month BETWEEN '1996-01' AND '1999-12' GROUP BY 1, 2")
def population_partials(spark: SparkSession, d: str) -> DataFrame:
    return citations.series(counted(spark, d).where(F.col("month").between("1996-01", "1999-12")), ["month", "field"]).drop("rate")


@query(SQL + """SELECT month, field, sum(late)::BIGINT AS events, sum(n_refs)::BIGINT AS refs,
round(CASE WHEN sum(n_refs) > 0 THEN sum(late)::DOUBLE / sum(n_refs) * 10000 END, 6) AS rate FROM counted GROUP BY GROUPING SETS ((month, field), (month))""")
def population_pooled(spark: SparkSession, d: str) -> DataFrame:
    return citations.series_and_pooled(counted(spark, d))


@query(SQL + "SELECT id, pub_date, n_refs, late FROM counted")
def late_ref_count(spark: SparkSession, d: str) -> DataFrame:
    lists = standins.references(spark, d).groupBy("id").agg(F.collect_list("ref").alias("refs"))
    works = standins.works(spark, d).join(lists, "id", "left")
    return citations.late_counts_of_lists(works, standins.targets(spark, d)).select("id", "pub_date", "n_refs", "late")


@query(SQL + """SELECT s.month, events, refs, rate FROM (SELECT strftime(m, '%Y-%m') AS month FROM range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 MONTH) r(m)) s
LEFT JOIN (SELECT month, sum(late)::BIGINT AS events, sum(n_refs)::BIGINT AS refs, round(CASE WHEN sum(n_refs) > 0 THEN sum(late)::DOUBLE / sum(n_refs) * 10000 END, 6) AS rate FROM counted GROUP BY 1) p USING (month)""")
def month_spine(spark: SparkSession, d: str) -> DataFrame:
    pooled = citations.series(counted(spark, d), ["month"]).drop("works")
    return citations.on_spine(pooled, citations.month_spine(spark, "1995-01", "2001-12"))


@query(SQL + "SELECT count(*) AS works, sum(late)::BIGINT AS events, min(year) AS first_year, max(year) AS last_year, count(*) FILTER (year >= 1998) AS recent FROM counted")
def scan_summary(spark: SparkSession, d: str) -> DataFrame:
    return counted(spark, d).agg(F.count("*").alias("works"), F.sum("late").alias("events"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_if(F.col("year") >= 1998).alias("recent"))


@query(SQL + "SELECT field, sum(late)::BIGINT AS events FROM counted GROUP BY 1 ORDER BY events DESC, field LIMIT 3")
def top_fields(spark: SparkSession, d: str) -> DataFrame:
    return counted(spark, d).groupBy("field").agg(F.sum("late").alias("events")).orderBy(F.desc("events"), "field").limit(3)


@query(SQL + "SELECT * FROM clean")
def retraction_clean(spark: SparkSession, d: str) -> DataFrame:
    return citations.clean_retractions(standins.retractions(spark, d))


@query(SQL + """SELECT count(*) FILTER (NOT n) AS nature, count(*) FILTER (n AND NOT o) AS no_doi, count(*) FILTER (n AND o AND rday IS NULL) AS no_date, count(*) FILTER (n AND o AND rday IS NOT NULL) AS kept
FROM (SELECT trim(nature) = 'Retraction' AS n, ndoi IS NOT NULL AND NOT contains(ndoi, 'unavailable') AS o, rday FROM tried)""")
def retraction_skips(spark: SparkSession, d: str) -> DataFrame:
    return citations.retraction_skips(standins.retractions(spark, d))


@query(SQL + "SELECT reason, count(*) AS n FROM clean GROUP BY 1 ORDER BY n DESC, reason LIMIT 10")
def reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return citations.clean_retractions(standins.retractions(spark, d)).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(10)


@query(SQL + "SELECT doi, retraction_date FROM clean")
def dedup_earliest(spark: SparkSession, d: str) -> DataFrame:
    return citations.clean_retractions(standins.retractions(spark, d)).select("doi", "retraction_date")


@query(SQL + "SELECT n.id, n.doi FROM norm n WHERE src = 'w' AND doi IN (SELECT doi FROM clean)")
def doi_semi_join(spark: SparkSession, d: str) -> DataFrame:
    works = standins.works(spark, d).select("id", scalars.norm_doi(F.col("doi")).alias("doi"))
    return works.join(citations.clean_retractions(standins.retractions(spark, d)).select("doi"), "doi", "left_semi").select("id", "doi")


@query(SQL + "SELECT DISTINCT c.*, n.id FROM clean c JOIN norm n ON n.src = 'w' AND n.doi = c.doi")
def doi_map(spark: SparkSession, d: str) -> DataFrame:
    return citations.doi_map(standins.works(spark, d), citations.clean_retractions(standins.retractions(spark, d)))


SUMS = "month string, field string, events long, refs long, works long"


def listed_works(spark: SparkSession, d: str) -> DataFrame:
    """Works with their references in an array, as a snapshot's files have them."""
    lists = standins.references(spark, d).groupBy("id").agg(F.collect_list("ref").alias("refs"))
    return standins.works(spark, d).join(lists, "id", "left").select("id", "pub_date", "month", "field", "n_refs", "refs")


@query(SQL + "SELECT month, field, sum(late)::BIGINT AS events, sum(n_refs)::BIGINT AS refs, count(*) AS works FROM counted GROUP BY 1, 2")
def resumed_series(spark: SparkSession, d: str) -> DataFrame:
    """The series over works that arrive as files in three instalments: each run adds the new files' partial sums, the last finds none."""
    folder, files = shared_path(spark, "totals"), shared_path(spark, "arriving")
    rows, targets = listed_works(spark, d), standins.targets(spark, d)
    totals = Totals(spark, folder, SUMS, ("month", "field"))
    parts = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(3)))
    for part in range(3):
        parts.where(F.col("part") == part).drop("part").write.mode("append").parquet(files)
        totals.add(rows.schema, files, lambda batch: citations.series(citations.late_counts_of_lists(batch, targets), ["month", "field"]).drop("rate"))
        if part == 1:
            totals.compact()
    totals.add(rows.schema, files, lambda batch: batch)
    return totals.read()


BUCKETS = 16


def stored_hits(spark: SparkSession, d: str) -> DataFrame:
    """References to targets, both of which are stored in buckets: neither is shuffled."""
    references = layout.bucketed(standins.references(spark, d), "ref", BUCKETS, "references")
    targets = layout.bucketed(standins.targets(spark, d).withColumnRenamed("id", "ref"), "ref", BUCKETS, "targets")
    return references.hint("merge").join(targets, "ref")


@query(SQL + "SELECT id, pub_date, late FROM counted WHERE late > 0")
def bucketed_late_refs(spark: SparkSession, d: str) -> DataFrame:
    """Works with late references, by references that were bucketed once and serve any set of targets."""
    hits = stored_hits(spark, d).join(standins.works(spark, d).select("id", "pub_date"), "id")
    return hits.where(F.col("pub_date") >= F.col("eligible")).groupBy("id", "pub_date").agg(F.count("*").alias("late"))


@query(SQL + "SELECT n.id, n.doi FROM norm n WHERE src = 'w' AND doi IN ('10.1000/w40', '10.1000/w41', '10.1000/w123')")
def works_by_doi(spark: SparkSession, d: str) -> DataFrame:
    """Some DOIs' works, from a table whose Bloom filters rule out most row groups."""
    works = standins.works(spark, d).select("id", scalars.norm_doi(F.col("doi")).alias("doi"))
    return layout.with_bloom_filters(works, ["doi"], "works").where(F.col("doi").isin("10.1000/w40", "10.1000/w41", "10.1000/w123"))
