"""The studies' inputs, taken from the generic tables of a test folder, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PHRASES
from ..functions import scalars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doi_sql(key: str) -> str:
    """Untidy DOIs, alike in both dialects."""
    k = f"cast({key} as string)"
    return f"CASE {key} % 5 WHEN 0 THEN concat('https://doi.org/10.1000/W', {k}) WHEN 1 THEN concat(' HTTP://DX.DOI.ORG/10.1000/w', {k}, '?ref=pdf ') WHEN 2 THEN concat('doi:10.1000/w', {k}, '.') WHEN 3 THEN concat('10.1000/w', {k}, '#sec),') ELSE NULL END"


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, doi, pub_date, month, field, source_id, year, n_cites, n_refs of each work, references or not."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr(doi_sql("o_orderkey")).alias("doi"),
        day.alias("pub_date"),
        scalars.month_of(day).alias("month"),
        scalars.named(F.col("o_orderpriority")).alias("field"),
        (F.col("o_custkey") % 50).alias("source_id"),
        F.year(day).cast("long").alias("year"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("n_cites"),
    )
    return rows.join(counts, "id", "left").withColumn("n_refs", F.coalesce("n", F.lit(0))).drop("n")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge (id, ref) for each reference, repeated ones too."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("ref"))


def retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events: record_id, nature, doi, retracted, reason, journal, all text but the first."""
    day = F.expr("date_add(DATE'1995-01-01', cast((p_partkey * 37) % 2000 as int))")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("record_id"),
        F.expr("CASE WHEN p_partkey % 7 = 0 THEN 'Correction' ELSE ' Retraction ' END").alias("nature"),
        F.expr(f"CASE WHEN p_partkey % 11 = 0 THEN 'unavailable' ELSE {doi_sql('(p_partkey % 500)')} END").alias("doi"),
        F.when(F.expr("p_partkey % 13 = 0"), "n/a").otherwise(F.concat_ws("/", F.month(day), F.dayofmonth(day), F.year(day))).alias("retracted"),
        F.expr("concat('+', p_type, ';+', p_brand, '; ')").alias("reason"),
        F.col("p_name").alias("journal"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique id and eligible date of retracted works."""
    day = F.expr("date_add(DATE'1995-01-01', cast((p_partkey * 37) % 2000 as int))")
    return table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("id"), scalars.eligible_from(day, 6).alias("eligible"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as hits of a phrase search."""
    listed = F.array(*map(F.lit, [*PHRASES, "regenerate response", "as an AI language model"]))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.element_at(listed, (F.col("doc_id") % 9 + 1).cast("int")).alias("phrase"),
        F.expr("CASE WHEN doc_id % 10 = 4 THEN concat('Detecting ChatGPT ', substring(text, 1, 40)) ELSE substring(text, 1, 60) END").alias("title"),
        F.expr("CASE WHEN doc_id % 10 = 3 THEN concat('A language model can detect chatgpt. ', text) ELSE text END").alias("abstract"),
        F.expr("CASE WHEN doc_id % 31 = 0 THEN NULL ELSE 2021 + doc_id % 6 END").alias("year"),
        F.expr("CASE WHEN doc_id % 17 = 0 THEN 'subfields/1702' ELSE 'subfields/2000' END").alias("subfield"),
        F.expr("CASE doc_id % 8 WHEN 0 THEN 'review' WHEN 1 THEN 'letter' WHEN 2 THEN 'preprint' ELSE 'article' END").alias("type"),
        F.floor(F.col("n_chars") / 700).cast("long").alias("n_refs"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: id, proxy, events and n_refs."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("proxy"), F.col("quality").cast("long").alias("events"), F.floor(F.col("n_chars") / 50).cast("long").alias("n_refs"))


_PHRASES = ", ".join("'" + p.replace("'", "''") + "'" for p in [*PHRASES, "regenerate response", "as an AI language model"])
#: The same tables for DuckDB.
SQL = f"""WITH works AS (
  SELECT o_orderkey AS id, {doi_sql('o_orderkey')} AS doi, o_orderdate::DATE AS pub_date, strftime(o_orderdate, '%Y-%m') AS month,
         coalesce(nullif(o_orderpriority, ''), 'Unknown') AS field, o_custkey % 50 AS source_id, year(o_orderdate)::BIGINT AS year,
         floor(o_totalprice / 1000)::BIGINT AS n_cites, coalesce(n, 0)::BIGINT AS n_refs
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
refs AS (SELECT l_orderkey AS id, l_partkey AS ref FROM lineitem),
pday AS (SELECT *, (DATE '1995-01-01' + ((p_partkey * 37) % 2000)::INT)::DATE AS day FROM part),
retractions AS (
  SELECT p_partkey AS record_id, CASE WHEN p_partkey % 7 = 0 THEN 'Correction' ELSE ' Retraction ' END AS nature,
         CASE WHEN p_partkey % 11 = 0 THEN 'unavailable' ELSE {doi_sql('(p_partkey % 500)')} END AS doi,
         CASE WHEN p_partkey % 13 = 0 THEN 'n/a' ELSE concat_ws('/', month(day), day(day), year(day)) END AS retracted,
         '+' || p_type || ';+' || p_brand || '; ' AS reason, p_name AS journal FROM pday),
targets AS (SELECT p_partkey AS id, (day + INTERVAL 6 MONTH)::DATE AS eligible FROM pday WHERE p_partkey % 20 = 0),
late AS (SELECT r.id, count(*)::BIGINT AS late FROM refs r JOIN targets t ON r.ref = t.id JOIN works w ON w.id = r.id WHERE w.pub_date >= t.eligible GROUP BY 1),
counted AS (SELECT w.*, coalesce(late, 0)::BIGINT AS late FROM works w LEFT JOIN late USING (id)),
candidates AS (
  SELECT doc_id AS id, [{_PHRASES}][doc_id % 9 + 1] AS phrase,
         CASE WHEN doc_id % 10 = 4 THEN 'Detecting ChatGPT ' || substring(text, 1, 40) ELSE substring(text, 1, 60) END AS title,
         CASE WHEN doc_id % 10 = 3 THEN 'A language model can detect chatgpt. ' || text ELSE text END AS abstract,
         CASE WHEN doc_id % 31 = 0 THEN NULL ELSE 2021 + doc_id % 6 END AS year,
         CASE WHEN doc_id % 17 = 0 THEN 'subfields/1702' ELSE 'subfields/2000' END AS subfield,
         CASE doc_id % 8 WHEN 0 THEN 'review' WHEN 1 THEN 'letter' WHEN 2 THEN 'preprint' ELSE 'article' END AS type,
         floor(n_chars / 700)::BIGINT AS n_refs FROM documents),
scored AS (SELECT doc_id AS id, toxic = 1 AS proxy, quality::BIGINT AS events, floor(n_chars / 50)::BIGINT AS n_refs FROM documents JOIN labels USING (doc_id)),
norm AS (SELECT id, nullif(rtrim(split_part(split_part(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(doi)),
  '^https://doi\\.org/', ''), '^http://doi\\.org/', ''), '^https://dx\\.doi\\.org/', ''), '^http://dx\\.doi\\.org/', ''), '^doi:', ''), '?', 1), '#', 1), '.,;)'), '') AS doi, src
  FROM (SELECT id, doi, 'w' AS src FROM works UNION ALL SELECT record_id, doi, 'r' FROM retractions)),
tried AS (SELECT r.*, n.doi AS ndoi, CAST(try_strptime(split_part(trim(retracted), ' ', 1), '%-m/%-d/%Y') AS DATE) AS rday FROM retractions r JOIN norm n ON n.src = 'r' AND n.id = record_id),
clean AS (SELECT * EXCLUDE n FROM (SELECT record_id, ndoi AS doi, rday AS retraction_date, trim(reason, ';+ ') AS reason, trim(journal) AS journal,
    row_number() OVER (PARTITION BY ndoi ORDER BY rday, record_id) AS n FROM tried
    WHERE trim(nature) = 'Retraction' AND ndoi IS NOT NULL AND NOT contains(ndoi, 'unavailable') AND rday IS NOT NULL) WHERE n = 1)
"""
