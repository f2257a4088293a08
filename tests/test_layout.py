"""Plans over stored layouts: no shuffle of bucketed sides, nested fields pruned from files, Bloom filters in them."""

import glob

from reflume.plans import citations, identifiers
from reflume.sources import layout

DATA = "/root/testdata/sf0.001"


def test_bucketed_join_shuffles_nothing(spark):
    hits = citations.stored_hits(spark, DATA)
    assert layout.exchanges(hits) == 0
    plain = citations.standins.references(spark, DATA).hint("merge").join(citations.standins.targets(spark, DATA).withColumnRenamed("id", "ref"), "ref")
    assert layout.exchanges(plain) == 2
    assert sorted(map(tuple, hits.select("id", "ref").collect())) == sorted(map(tuple, plain.select("id", "ref").collect()))


def test_only_the_nested_name_is_read(spark):
    plan = identifiers.field_names(identifiers.stored_topics(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,topic:struct<field:struct<display_name:string>>>" in plan


def test_bloom_filters_are_written_and_dois_pushed_down(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id", "concat('10.1/w', id * 7) as doi")
    stored = layout.with_bloom_filters(rows, ["doi"], "dois", 2000)
    found = stored.where("doi = '10.1/w700'")
    assert [r.id for r in found.collect()] == [100]
    assert "PushedFilters: [IsNotNull(doi), EqualTo(doi,10.1/w700)]" in found._jdf.queryExecution().executedPlan().toString()
    rows.write.parquet(str(tmp_path / "plain"))
    size = lambda paths: sum(len(open(f, "rb").read()) for f in paths)
    with_ = size(f.removeprefix("file://").removeprefix("file:") for f in stored.inputFiles())
    assert with_ > size(glob.glob(str(tmp_path / "plain" / "*.parquet"))) + 1500  # a filter of 2,000 values takes its bytes
