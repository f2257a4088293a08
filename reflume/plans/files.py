"""Queries that write files and read them back: each compares what comes back with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import citations, estimates
from ..session import shared_path
from ..sources import files, standins
from ..sources.standins import SQL, table
from . import citations as late
from . import estimates as estimated
from .queries import ORACLES, query


@query(ORACLES["retraction_clean"])
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Retraction events through a CSV file, then cleaned."""
    path = shared_path(spark, "csv")
    files.write_csv(standins.retractions(spark, d), path)
    return citations.clean_retractions(files.read_csv(spark, path).withColumn("record_id", F.col("record_id").cast("long")))


@query(SQL + "SELECT month, field, sum(late)::BIGINT AS events, sum(n_refs)::BIGINT AS refs FROM counted GROUP BY 1, 2")
def csv_shards(spark: SparkSession, d: str) -> DataFrame:
    """Partial series of three shards in CSV files, beside an older, incomplete set, merged."""
    folder = shared_path(spark, "shards")
    rows = late.counted(spark, d)
    for k in range(3):
        files.write_csv(citations.series(rows.where(F.col("id") % 3 == k), ["month", "field"]).select("month", "field", "events", "refs"), f"{folder}/numer_{k}of3.csv")
    files.write_csv(spark.createDataFrame([("1995-01", "old", 9, 9)], "month string, field string, events long, refs long"), f"{folder}/numer_1of25.csv")
    read = files.read_shards(spark, folder, "numer_")
    return read.groupBy("month", "field").agg(F.sum(F.col("events").cast("long")).alias("events"), F.sum(F.col("refs").cast("long")).alias("refs"))


@query("SELECT 'there' AS name, count(*) AS works, round(avg(o_totalprice), 4) AS price, list_sort(list(DISTINCT o_orderpriority))[1] AS first FROM orders")
def json_document(spark: SparkSession, d: str) -> DataFrame:
    """A result as a JSON document, and one that is missing."""
    path = shared_path(spark, "document")
    files.write_json(table(spark, d, "orders").agg(F.count("*").alias("works"), F.round(F.avg("o_totalprice"), 4).alias("price"), F.sort_array(F.collect_set("o_orderpriority")).alias("fields")), path)
    schema = "works long, price double, fields array<string>"
    both = files.read_json(spark, path, schema).withColumn("name", F.lit("there")).unionByName(files.read_json(spark, f"{path}-absent", schema).withColumn("name", F.lit("absent")))
    return both.select("name", "works", "price", F.col("fields")[0].alias("first"))


@query("SELECT event_type, count(*) AS n, sum(CAST(props::JSON->>'k' AS BIGINT))::BIGINT AS k FROM events GROUP BY 1")
def jsonl_scan(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "lines")
    files.write_jsonl(table(spark, d, "events").select("event_type", F.from_json("props", "k long").alias("props")), path)
    return files.read_jsonl(spark, path, "event_type string, props struct<k:long>").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("props.k").alias("k"))


@query("""SELECT '2026-06-26' AS date, path, regexp_extract(path, '[^/]*$') || '@2024-01-' || lpad((k % 28 + 1)::VARCHAR, 2, '0') AS key, row_number() OVER (ORDER BY path) - 1 AS place, n AS record_count
FROM (SELECT n_nationkey AS k, n_regionkey::BIGINT AS n, 'bucket/works/updated_date=2024-01-' || lpad((n_nationkey % 28 + 1)::VARCHAR, 2, '0') || '/part_' || n_nationkey || '.parquet' AS path FROM nation)""")
def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of nations as files, written and read back, with each file's key and place."""
    path, k = shared_path(spark, "manifest"), F.col("n_nationkey").cast("string")
    url = F.concat(F.lit("s3://bucket/works/updated_date=2024-01-"), F.lpad((F.col("n_nationkey") % 28 + 1).cast("string"), 2, "0"), F.lit("/part_"), k, F.lit(".parquet"))
    each = F.struct(url.alias("url"), F.col("n_regionkey").cast("long").alias("record_count"))
    files.write_json(table(spark, d, "nation").agg(F.lit("2026-06-26").alias("date"), F.sum("n_regionkey").alias("record_count"), F.collect_list(each).alias("files")), path)
    return files.manifest_files(files.read_json(spark, path, files.MANIFEST))


_VALUES = "SELECT c_mktsegment AS name, CASE WHEN c_mktsegment LIKE '%U%' THEN NULL ELSE count(*)::VARCHAR END AS value FROM customer GROUP BY 1"


@query(f"""WITH v AS ({_VALUES}), l AS (SELECT 1 AS part, name, '- `' || name || '`: ' || coalesce(value, '{files.MISSING}') AS line FROM v UNION ALL SELECT 4, name, '- ' || name FROM v WHERE value IS NULL
UNION ALL SELECT 3, '', '## Still missing: ' || count(*) FROM v WHERE value IS NULL UNION ALL SELECT 0, '', '# Values' UNION ALL SELECT 0, '~', '' UNION ALL SELECT 2, '', '')
SELECT row_number() OVER (ORDER BY part, name) - 1 AS n, line FROM l""")
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").cast("string").alias("value"))
    return files.report(values.withColumn("value", F.when(~F.contains("name", F.lit("U")), F.col("value"))), "Values")


@query(f"WITH s AS ({ORACLES['bounds_by_stratum']}) SELECT stratum AS label, 'assisted' AS series, round(a_lo * 100, 4) AS lo, round(a_hi * 100, 4) AS hi FROM s WHERE a_lo IS NOT NULL")
def figure_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Bars of the bounds by stratum, in percent: what the strata's figure shows."""
    rows = estimated.bounds_by_stratum(spark, d)
    return estimates.interval_bars(rows, "stratum", {"assisted": ("a_lo", "a_hi")})
