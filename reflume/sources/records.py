"""Harvested records: a work as a service's JSON gives it, and its sixteen columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

#: What is read of a record; anything else in it is left alone.
RECORD = """id string, doi string, title string, publication_year long, publication_date string, type string,
primary_topic struct<id:string,display_name:string,subfield:struct<id:string>,field:struct<display_name:string>>,
primary_location struct<source:struct<id:string,display_name:string>>,
referenced_works_count long, cited_by_count long, abstract_inverted_index map<string,array<long>>"""
ABSTRACT_CHARS = 2000
COLUMNS = ["phrase", "id", "doi", "title", "year", "date", "type", "topic", "topic_id", "subfield_id", "field", "source_id", "source_name", "n_refs", "n_cites", "abstract"]


def flattened(records: DataFrame, record: str = "record", phrase: str = "phrase") -> DataFrame:
    """COLUMNS of each record, a JSON text, that a phrase has brought; what is missing or null is empty or 0, but for doi, year and date."""
    r = F.col("_r")
    parsed = records.select(F.col(phrase).alias("phrase"), F.from_json(record, RECORD).alias("_r"))

    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    topic, source = r["primary_topic"], r["primary_location"]["source"]
    return parsed.select(
        "phrase",
        scalars.short_id(r["id"]).alias("id"),
        scalars.norm_doi(r["doi"]).alias("doi"),
        text(r["title"]).alias("title"),
        r["publication_year"].alias("year"),
        r["publication_date"].alias("date"),
        r["type"].alias("type"),
        text(topic["display_name"]).alias("topic"),
        text(scalars.short_id(topic["id"])).alias("topic_id"),
        text(topic["subfield"]["id"]).alias("subfield_id"),
        text(topic["field"]["display_name"]).alias("field"),
        text(scalars.short_id(source["id"])).alias("source_id"),
        text(source["display_name"]).alias("source_name"),
        F.coalesce(r["referenced_works_count"], F.lit(0)).alias("n_refs"),
        F.coalesce(r["cited_by_count"], F.lit(0)).alias("n_cites"),
        F.substring(text(scalars.inverted_text(r["abstract_inverted_index"])), 1, ABSTRACT_CHARS).alias("abstract"),
    )
