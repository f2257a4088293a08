"""Queries on phrase hits, cohorts and their controls, unresolvable references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import META_TERMS, META_TITLE, PHRASES
from ..functions import scalars
from ..operators import classify as rules
from ..operators import cohort as cohorts
from ..operators import resolve
from ..session import staged
from ..sources import standins
from ..sources.standins import SQL
from . import citations as late
from .queries import query

_TITLE = META_TITLE.replace("'", "''")
_LISTED = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"
_REASON = f"""CASE WHEN NOT list_contains({_LISTED}, phrase) THEN 'phrase_retired' WHEN year IS NULL OR year < 2023 THEN 'pre_chatgpt'
WHEN subfield IN ('subfields/1702', 'subfields/1703') THEN 'ai_subfield' WHEN regexp_matches(title, '(?i){_TITLE}') THEN 'meta_title'
WHEN len(hits) >= 2 THEN 'meta_abstract:' || array_to_string(hits[1:3], '|')
WHEN type NOT IN ('article', 'review', 'book-chapter', 'preprint', 'dissertation') THEN 'type:' || type WHEN n_refs = 0 THEN 'no_references' ELSE 'kept' END"""
RULED = SQL + f""", hit AS (SELECT *, list_filter({META_TERMS!r}, lambda t: contains(lower(abstract), t)) AS hits FROM candidates), ruled AS (SELECT *, {_REASON} AS reason FROM hit)
"""
#: Cohort, pool and matches for DuckDB.
MATCHED = SQL + """, cohort AS (SELECT * FROM counted WHERE id % 97 = 0),
pool AS (SELECT * EXCLUDE n FROM (SELECT c.*, row_number() OVER (PARTITION BY source_id, year ORDER BY md5(id || ':0'), id) AS n FROM counted c
  WHERE n_refs > 0 AND (source_id, year) IN (SELECT (source_id, year) FROM cohort) AND id NOT IN (SELECT id FROM cohort)) WHERE n <= 60),
pairs AS (SELECT a.id AS artifact_id, c.id AS control_id, c.n_refs AS control_n_refs, c.n_cites AS control_n_cites, c.n_refs BETWEEN a.n_refs * 0.75::DOUBLE AND a.n_refs * 1.25::DOUBLE AS in_band,
  abs(ln(1 + c.n_refs) - ln(1 + a.n_refs)) + 0.5::DOUBLE * abs(ln(1 + c.n_cites) - ln(1 + a.n_cites)) AS distance FROM cohort a JOIN pool c USING (source_id, year)),
enough AS (SELECT *, count(*) FILTER (in_band) OVER (PARTITION BY artifact_id) >= 5 AS enough FROM pairs),
matches AS (SELECT artifact_id, control_id, CASE WHEN enough THEN 'venue_year' ELSE 'venue_year_relaxed' END AS match_basis, control_n_refs, control_n_cites
  FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY round(distance, 9), control_id) AS n FROM enough WHERE NOT enough OR in_band) WHERE n <= 5),
bad AS (SELECT r.id, count(*)::BIGINT AS n_refs, count(*) FILTER (r.ref % 23 = 0)::BIGINT AS n_unresolvable FROM refs r GROUP BY 1),
papers AS (SELECT id, 'artifact' AS "group" FROM cohort UNION ALL SELECT DISTINCT control_id, 'control' FROM matches)
"""


@query(RULED + "SELECT id, reason, reason = 'kept' AS keep FROM ruled")
def classify(spark: SparkSession, d: str) -> DataFrame:
    return rules.classify(standins.candidates(spark, d)).select("id", "reason", "keep")


@query(RULED + "SELECT id, len(hits) AS n, array_to_string(hits[1:3], '|') AS terms FROM hit")
def meta_abstract_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = rules.meta_hits(F.col("abstract"))
    return standins.candidates(spark, d).select("id", F.size(hits).cast("long").alias("n"), F.array_join(F.slice(hits, 1, 3), "|").alias("terms"))


@query(RULED + f"""SELECT phrase, count(*) AS n_hits, count(*) FILTER (year < 2023) AS n_pre, round(count(*) FILTER (year < 2023) / count(*)::DOUBLE, 4) AS false_positive_rate,
count(*) - count(*) FILTER (year < 2023) AS n_post, NOT list_contains({_LISTED}, phrase) AS retired FROM candidates WHERE year IS NOT NULL GROUP BY phrase""")
def phrase_validation(spark: SparkSession, d: str) -> DataFrame:
    return rules.phrase_validation(standins.candidates(spark, d))


def counted(spark: SparkSession, d: str) -> DataFrame:
    """Works with their late references, worked out once: cohort, pool and outcomes all start from them."""
    return staged(late.counted(spark, d).select("id", "pub_date", "source_id", "year", "n_refs", "n_cites", "late"), "counted")


def members(works: DataFrame) -> tuple[DataFrame, DataFrame]:
    cohort = works.where("id % 97 = 0")
    return cohort, cohorts.control_pool(works, cohort)


def papers(works: DataFrame) -> DataFrame:
    cohort, pool = members(works)
    controls = cohorts.match(cohort, pool).select(F.col("control_id").alias("id")).distinct()
    return cohort.select("id", F.lit("artifact").alias("group")).unionByName(controls.withColumn("group", F.lit("control")))


def unresolvable(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each work with references; a reference resolves unless 23 divides it."""
    known = standins.references(spark, d).select("ref").distinct().where("ref % 23 <> 0")
    looked = resolve.looked_up(standins.references(spark, d), "ref", known)
    return looked.groupBy("id").agg(F.count("*").alias("n_refs"), F.count_if(~F.col("resolves")).alias("n_unresolvable"))


@query(MATCHED + "SELECT DISTINCT source_id, year FROM cohort")
def venue_years(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.venue_years(late.counted(spark, d).where("id % 97 = 0"))


@query(MATCHED + "SELECT id, n_refs, n_cites, late FROM cohort")
def cohort_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return late.counted(spark, d).where("id % 97 = 0").select("id", "n_refs", "n_cites", "late")


@query(MATCHED + "SELECT id, source_id, year, n_refs FROM pool")
def control_pool(spark: SparkSession, d: str) -> DataFrame:
    return members(counted(spark, d))[1].select("id", "source_id", "year", "n_refs")


@query(MATCHED + "SELECT * FROM matches")
def match_controls(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.match(*members(counted(spark, d)))


@query(MATCHED + "SELECT id, n_refs, late FROM pool WHERE id IN (SELECT control_id FROM matches)")
def matched_controls(spark: SparkSession, d: str) -> DataFrame:
    cohort, pool = members(counted(spark, d))
    return pool.join(cohorts.match(cohort, pool).select(F.col("control_id").alias("id")).distinct(), "id", "left_semi").select("id", "n_refs", "late")


@query(MATCHED + """SELECT (SELECT count(*) FROM matches) AS pairs, (SELECT round(avg(n_refs), 6) FROM cohort) AS cohort_refs,
(SELECT round(avg(n_refs), 6) FROM pool WHERE id IN (SELECT control_id FROM matches)) AS control_refs""")
def cohort_summary(spark: SparkSession, d: str) -> DataFrame:
    cohort, pool = members(counted(spark, d))
    pool = staged(pool, "pool")
    pairs = staged(cohorts.match(cohort, pool), "pairs")
    used = pool.join(pairs.select(F.col("control_id").alias("id")).distinct(), "id", "left_semi")
    one = [pairs.agg(F.count("*").alias("pairs")), cohort.agg(F.round(F.avg("n_refs"), 6).alias("cohort_refs")), used.agg(F.round(F.avg("n_refs"), 6).alias("control_refs"))]
    return one[0].crossJoin(one[1]).crossJoin(one[2])  # single rows


@query(MATCHED + "SELECT * FROM papers")
def papers_to_check(spark: SparkSession, d: str) -> DataFrame:
    return papers(counted(spark, d))


@query(MATCHED + """SELECT "group", round(sum(late) / sum(n_refs)::DOUBLE * 1000, 6) AS rate, count(*) AS papers FROM counted JOIN papers USING (id) GROUP BY 1""")
def rate_ratio(spark: SparkSession, d: str) -> DataFrame:
    works = counted(spark, d)
    rows = works.join(papers(works), "id")
    return rows.groupBy("group").agg(F.round(cohorts.rate_of(F.col("late"), F.col("n_refs")), 6).alias("rate"), F.count("*").alias("papers"))


@query(MATCHED + "SELECT * FROM bad")
def unresolvable_per_paper(spark: SparkSession, d: str) -> DataFrame:
    return unresolvable(spark, d)


@query(MATCHED + """SELECT "group", count(*) AS papers, sum(n_refs)::BIGINT AS refs, sum(n_unresolvable)::BIGINT AS unresolvable, round(sum(n_unresolvable) / sum(n_refs)::DOUBLE * 1000, 6) AS rate FROM papers JOIN bad USING (id) GROUP BY 1""")
def unresolvable_by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = unresolvable(spark, d).join(papers(counted(spark, d)), "id")
    return rows.groupBy("group").agg(F.count("*").alias("papers"), F.sum("n_refs").alias("refs"), F.sum("n_unresolvable").alias("unresolvable"), F.round(cohorts.rate_of(F.col("n_unresolvable"), F.col("n_refs")), 6).alias("rate"))


_TITLE_OF = "CASE WHEN {k} % 4 = 0 THEN 'short' ELSE concat('A title that is long enough of ', cast({k} AS string)) END"


@query(SQL + f"""SELECT id, doi, title, CASE WHEN doi IS NOT NULL THEN doi NOT IN (SELECT doi FROM norm WHERE src = 'r' AND doi IS NOT NULL)
WHEN length(title) < 15 THEN false ELSE lower(title) NOT IN (SELECT lower({_TITLE_OF.format(k='record_id')}) FROM retractions) END AS unresolvable FROM (SELECT id, doi, {_TITLE_OF.format(k='id')} AS title FROM norm WHERE src = 'w')""")
def unresolvable_refs(spark: SparkSession, d: str) -> DataFrame:
    """References against the registry of known works, by DOI and else by title."""
    rows = standins.works(spark, d).select("id", scalars.norm_doi(F.col("doi")).alias("doi"), F.expr(_TITLE_OF.format(k="id")).alias("title"))
    known = standins.retractions(spark, d).select(scalars.norm_doi(F.col("doi")).alias("doi"), F.expr(_TITLE_OF.format(k="record_id")).alias("title"))
    return resolve.unresolvable(rows, known)


@query(MATCHED + "SELECT 'cited, not listed' AS issue, id FROM (SELECT DISTINCT ref AS id FROM refs EXCEPT SELECT p_partkey FROM part) UNION ALL SELECT 'listed, not cited', id FROM (SELECT p_partkey AS id FROM part EXCEPT SELECT ref FROM refs)")
def citation_integrity(spark: SparkSession, d: str) -> DataFrame:
    cited = standins.references(spark, d).select(F.col("ref").alias("id")).distinct()
    listed = standins.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    one = cited.join(listed, "id", "left_anti").select(F.lit("cited, not listed").alias("issue"), "id")
    return one.unionByName(listed.join(cited, "id", "left_anti").select(F.lit("listed, not cited").alias("issue"), "id"))
