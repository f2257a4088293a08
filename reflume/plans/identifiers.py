"""Queries on sources, identifiers, dates, texts' representations, samples and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MARKERS
from ..functions import scalars
from ..operators import classify, resolve, sampling
from ..session import staged
from ..sources import standins
from ..sources.standins import SQL, table
from .queries import query

#: Words that do occur in the test folders' texts; their own markers hardly do.
WORDS = ["the", "of", "and", "with", "for", "der", "les", "que"]
HITS = ["the and", "in the", "of that", "et les", "der die"]


@query("SELECT o_orderkey AS id, o_orderdate::DATE AS pub_date FROM orders WHERE o_orderdate >= DATE '1996-01-01'")
def scan_project(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("pub_date"))


@query("SELECT n_nationkey AS k, n_name AS name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) WHERE i % 4 = 1")
def shard_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return sampling.shard(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), "k", 1, 4)


@query("""SELECT field, sum(n)::BIGINT AS n FROM (SELECT o_orderpriority AS field, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1
UNION ALL SELECT o_orderpriority, count(*) FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) GROUP BY 1""")
def union_shards(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("field"))
    parts = [rows.where(F.col("o_orderkey") % 2 == k).groupBy("field").agg(F.count("*").alias("n")) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).groupBy("field").agg(F.sum("n").alias("n"))


@query("""WITH f AS (SELECT 's_' || (n_nationkey % 3) || 'of' || CASE WHEN n_nationkey < 3 THEN 3 ELSE 25 END || '_' || n_nationkey || 'of' || CASE WHEN n_nationkey < 3 THEN 3 ELSE 25 END || '.csv' AS file FROM nation),
t AS (SELECT file, regexp_extract(file, '_(\\d+)of(\\d+)\\.csv$', 2)::INT AS n FROM f) SELECT file, n FROM t WHERE n = (SELECT n FROM t GROUP BY n ORDER BY count(*) DESC, n DESC LIMIT 1)""")
def complete_shard_set(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("n_nationkey") < 3, "3").otherwise("25")
    k = F.col("n_nationkey")
    return sampling.complete_set(table(spark, d, "nation").select(F.concat(F.lit("s_"), (k % 3).cast("string"), F.lit("of"), n, F.lit("_"), k.cast("string"), F.lit("of"), n, F.lit(".csv")).alias("file")))


@query("SELECT doc_id, p AS phrase FROM documents, unnest(" + repr(HITS) + ") t(p) WHERE contains(lower(text), lower(p))")
def phrase_harvest(spark: SparkSession, d: str) -> DataFrame:
    return classify.harvest(table(spark, d, "documents").select("doc_id", "text"), HITS).select("doc_id", "phrase")


@query(SQL + "SELECT id, doi, doi IS NOT NULL AND doi IN (SELECT doi FROM norm WHERE src = 'r' AND doi IS NOT NULL) AS resolves FROM norm WHERE src = 'w'")
def resolve_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = standins.works(spark, d).select("id", scalars.norm_doi(F.col("doi")).alias("doi"))
    return resolve.looked_up(rows, "doi", standins.retractions(spark, d).select(scalars.norm_doi(F.col("doi")).alias("doi"))).select("id", "doi", "resolves")


@query("SELECT item_id, length(text) AS n_chars FROM benchmark WHERE text IS NOT NULL")
def corpus_with_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").where("text is not null").select("item_id", F.length("text").cast("long").alias("n_chars"))


@query("SELECT c_custkey AS id, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE c_mktsegment END, ''), 'Unknown') AS field FROM customer")
def nested_project(spark: SparkSession, d: str) -> DataFrame:
    """The field's name of works that are stored with their whole topics; the scan reads nothing else of them."""
    return field_names(stored_topics(spark, d))


def stored_topics(spark: SparkSession, d: str) -> DataFrame:
    """Works with nested topics, as a snapshot's files have them."""
    name = F.expr("CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE c_mktsegment END")
    whole = F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("display_name"), F.struct(F.col("c_nationkey").alias("id"), name.alias("display_name")).alias("field"), F.col("c_acctbal").alias("score"))
    return staged(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), whole.alias("topic"), F.col("c_nationkey").alias("n_cites")), "topics")


def field_names(rows: DataFrame) -> DataFrame:
    return rows.select("id", scalars.named(F.col("topic.field.display_name")).alias("field"))


@query("SELECT o_orderkey AS k, substr('https://works.example/' || o_orderkey, 23) AS id FROM orders")
def id_strip(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://works.example/"), F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), scalars.without_prefix(url, 22).alias("id"))


@query("SELECT page_id, nullif(regexp_extract(nullif(url, ''), '[^/]*$'), NULL) AS id FROM pages")
def id_short(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", scalars.short_id(F.col("url")).alias("id"))


@query(SQL + "SELECT id, doi FROM norm WHERE src = 'w'")
def norm_doi(spark: SparkSession, d: str) -> DataFrame:
    return standins.works(spark, d).select("id", scalars.norm_doi(F.col("doi")).alias("doi"))


@query("SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> ''), ' ') AS text FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\r]')")
def invert_index(spark: SparkSession, d: str) -> DataFrame:
    """Every whole text to its inverted index and back."""
    word = table(spark, d, "documents").select("doc_id", F.posexplode(F.array_remove(F.split("text", r"[ \t\n\r]+"), "")).alias("at", "word"))
    lists = word.groupBy("doc_id", "word").agg(F.collect_list("at").alias("places")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("inverted"))
    return lists.select("doc_id", scalars.inverted_text(F.col("inverted")).alias("text"))


@query("SELECT doc_id, substring(text, 1, 2000) AS text FROM documents")
def text_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 2000).alias("text"))


@query("SELECT event_id, event_type AS type, coalesce(CAST(props::JSON->>'k' AS BIGINT), 0) AS k, coalesce(props::JSON->>'none', 'Unknown') AS field FROM events")
def flatten_record(spark: SparkSession, d: str) -> DataFrame:
    record = F.from_json("props", "k long, none string")
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("type"), F.coalesce(record["k"], F.lit(0)).alias("k"), scalars.named(record["none"]).alias("field"))


@query(SQL + "SELECT record_id, rday AS day FROM tried")
def parse_date(spark: SparkSession, d: str) -> DataFrame:
    return standins.retractions(spark, d).select("record_id", scalars.parse_date(F.col("retracted")).alias("day"))


@query("SELECT o_orderkey AS id, (o_orderdate::DATE + INTERVAL 6 MONTH)::DATE AS eligible FROM orders")
def eligibility_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), scalars.eligible_from(F.col("o_orderdate").cast("date"), 6).alias("eligible"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate)::BIGINT AS year, count(*) AS n FROM orders GROUP BY 1, 2")
def month_bucket(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").groupBy(scalars.month_of(day).alias("month"), F.year(day).cast("long").alias("year")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS id, (o_orderdate::DATE - DATE '1970-01-01')::BIGINT AS day FROM orders")
def epoch_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), scalars.epoch_days(F.col("o_orderdate").cast("date")).alias("day"))


@query("SELECT page_id, round(('0x' || substr(md5(url), 1, 8))::BIGINT / 4294967295.0::DOUBLE, 9) AS fraction FROM pages")
def stable_fraction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.round(scalars.stable_fraction(F.col("url")), 9).alias("fraction"))


_VOCABULARY = """list_distinct(list_transform(regexp_split_to_array(trim(text), '[ \\t\\n\\r]+'), lambda w: lower(trim(w, ' ",:{}[]().;'))))"""


@query(f"SELECT doc_id, len({_VOCABULARY}) AS n_words FROM documents")
def vocab_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(scalars.vocabulary(F.col("text"))).cast("long").alias("n_words"))


@query(f"SELECT doc_id, len(list_intersect({_VOCABULARY}, {WORDS!r})) AS score, len(list_intersect({_VOCABULARY}, {MARKERS!r})) AS marker_score FROM documents")
def lexical_score(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", scalars.marker_score(text, WORDS).alias("score"), scalars.marker_score(text, MARKERS).alias("marker_score"))


@query(f"SELECT doc_id, len(list_intersect({_VOCABULARY}, {WORDS!r})) >= 5 AS proxy FROM documents")
def lexical_proxy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", (scalars.marker_score(F.col("text"), WORDS) >= 5).alias("proxy"))


@query(f"""SELECT doc_id, n_chars, len(list_intersect({_VOCABULARY}, {WORDS!r})) AS score FROM documents
WHERE ('0x' || substr(md5(source), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.3 AND n_chars > 0 AND text <> ''""")
def lexical_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.cluster_sample(table(spark, d, "documents").select("doc_id", "source", "text", "n_chars"), "source", 0.3).where("n_chars > 0 and text <> ''")
    return rows.select("doc_id", "n_chars", scalars.marker_score(F.col("text"), WORDS).alias("score"))


@query("SELECT doc_id, source FROM documents WHERE ('0x' || substr(md5(source), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.2")
def hash_cluster_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.cluster_sample(table(spark, d, "documents").select("doc_id", "source"), "source", 0.2)


@query("SELECT doc_id, source, seen FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS seen, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':7'), doc_id) AS n FROM documents) WHERE n <= 20")
def reservoir_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source")
    return sampling.reservoir(rows, ["source"], "doc_id", 20, 7).join(sampling.seen(rows, ["source"]), "source").select("doc_id", "source", "seen")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || ':20260813'), doc_id LIMIT 100")
def validation_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.bounded_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 100, 20260813)


@query("""WITH k AS (SELECT title, list_sort(string_split(lower(title), ' ')) AS words FROM (SELECT DISTINCT p_name || ' ' || p_type AS title FROM part))
SELECT 'r ' || a.title AS ref_id, min(b.title) AS known_id, 100.0::DOUBLE AS score FROM k a JOIN k b USING (words) GROUP BY a.title""")
def fuzzy_title(spark: SparkSession, d: str) -> DataFrame:
    """Titles with their words in reverse, each against all: the same words score 100, ties to the first title."""
    names = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("title")).distinct()
    references = names.select(F.concat(F.lit("r "), F.col("title")).alias("ref_id"), F.concat_ws(" ", F.reverse(F.split("title", " "))).alias("title"))
    return resolve.fuzzy_match(references, names.select(F.col("title").alias("known_id"), "title"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def resumable_ingest(spark: SparkSession, d: str) -> DataFrame:
    from ..session import shared_path
    from ..streaming.ingest import ingest

    folder = shared_path(spark, "ingest")
    schema = table(spark, d, "events").schema
    if not isinstance(schema, T.StructType):
        raise TypeError("events has no schema")
    for _ in range(2):  # the second run finds nothing new
        ingest(spark, schema, f"{d}/events.parquet*", f"{folder}/rows", f"{folder}/progress")
    return spark.read.schema(schema).parquet(f"{folder}/rows").groupBy("event_type").agg(F.count("*").alias("n"))
