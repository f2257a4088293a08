"""Each registered query of the studies against its SQL, over the smallest tables; all columns pruned where that matters."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from reflume.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for name in os.listdir(DATA):
        made.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return made


def plain(frame, columns):
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return None
        if isinstance(v, pd.Timestamp):
            return str(v.date())
        return float(v) if isinstance(v, (int, float)) else str(v)

    return sorted((tuple(value(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    found, wanted = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    assert plain(found, columns) == plain(wanted, columns)


@pytest.mark.parametrize("name", ["classify", "registry_first"])
def test_titles_beside_other_letters_equal_sql(spark, duck, tmp_path, name):
    """Words beside letters that aren't ASCII, and a letter whose lower case isn't one code point."""
    texts = ["se \u00f1 ja.\n\u00d1llm", "llm\u00e9", "llm\u0301 x", "\u00e9 llm", "xllm", "llm_", "ART\u0130FACT and PLAG\u0130AR", "plain", None]
    rows = [(k, t, "en", "s", 1400) for k, t in zip([27 * 31 * i + 2 for i in range(400)], texts * 45)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    own = duck.cursor()
    own.execute("CREATE SCHEMA odd")
    for t in os.listdir(DATA):
        own.execute(f"CREATE VIEW odd.{t.removesuffix('.parquet')} AS SELECT * FROM main.{t.removesuffix('.parquet')}")
    own.execute(f"CREATE OR REPLACE VIEW odd.documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    try:
        own.execute("SET schema = 'odd'")
        found, wanted = QUERIES[name](spark, str(tmp_path)).toPandas(), own.execute(ORACLES[name]).fetchdf()
    finally:
        own.execute("SET schema = 'main'")
        own.execute("DROP SCHEMA odd CASCADE")
    columns = sorted(found.columns)
    assert plain(found, columns) == plain(wanted, columns)
    assert {"meta_title", "kept"} <= set(found["reason"]) and found["reason"].str.startswith("meta_abstract:").any()


def test_first_hits_of_odd_rows_equal_sql(spark, tmp_path):
    """Counts that are missing, and ids below zero, on either side of it and of every rest."""
    rows = [(k, "plain", "en", "s", None if k % 5 < 2 else 1400 * (k % 3)) for k in range(-400, 400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    own = duckdb.connect()
    for t in ["orders", "lineitem", "part"]:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    own.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found, wanted = QUERIES["registry_first"](spark, str(tmp_path)).toPandas(), own.execute(ORACLES["registry_first"]).fetchdf()
    columns = sorted(found.columns)
    assert plain(found, columns) == plain(wanted, columns)
    assert {"kept", "no_references"} <= set(found["reason"]) and found["id"].min() < 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_scan_is_pruned(spark):
    plan = QUERIES["scan_project"](spark, DATA)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan and "GreaterThanOrEqual(o_orderdate" in plan


def test_harvested_records_shuffle_nothing(spark):
    assert "Exchange" not in QUERIES["harvested_records"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_ingest_resumes(spark, tmp_path):
    from reflume.streaming.ingest import ingest

    rows = spark.range(10)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark, rows.schema, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest(spark, rows.schema, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15
