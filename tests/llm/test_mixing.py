from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reflume.llm import mixing
from reflume.llm.common import materialize

from .cases import documents, none


def skewed(spark):
    sizes = {"hot": 700, "mid": 200, "low": 90, "": 7, "one": 1}
    rows = [(n, s) for n, s in enumerate(s for s, k in sizes.items() for _ in range(k))]
    return spark.createDataFrame(rows, "doc_id long, source string")


def test_every_slot_is_fair(spark):
    weights = {r._source: r.parts for r in mixing.targets(skewed(spark), 100).collect()}
    assert sum(weights.values()) == 100 and min(weights.values()) >= 1 and weights["hot"] <= 35
    order = [r._source for r in mixing.schedule(mixing.targets(skewed(spark), 100), 100).orderBy("turn_slot").collect()]
    done = Counter()
    assert len(order) == 100
    for t, source in enumerate(order, 1):
        done[source] += 1
        assert all(abs(done[s] - w * t / 100) < 1 for s, w in weights.items())


def test_windows_and_wholeness(spark):
    docs = skewed(spark)
    rows = mixing.mix(docs, 8, 100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(998)) and len({r.place for r in rows}) == 998
    assert all(r.release <= r.slot < r.deadline for r in rows)
    kept = mixing.mixture(docs, 1, 100)
    count = Counter(r.source for r in kept.collect())
    end = mixing.horizon(docs, 1, 100).first().horizon
    assert sum(count.values()) == end
    for r in mixing.targets(docs, 100).collect():
        assert abs(count[r._source] - r.parts * end / 100) < 1


def test_equals_sql(spark):
    docs = skewed(spark).withColumn("text", F.lit("x"))
    duck = duckdb.connect()
    duck.register("documents", docs.toPandas())
    wanted = duck.execute(mixing.oracle()).fetchdf()
    found = mixing.mix(docs).select(*wanted.columns).toPandas()
    assert sorted(map(tuple, found.values.tolist())) == sorted(map(tuple, wanted.values.tolist()))


def test_odd_rows(spark):
    docs = documents(spark)
    assert mixing.mix(docs).count() == docs.count()
    assert mixing.mixture(docs).columns == docs.columns
    assert mixing.mix(none(spark)).count() == 0 and mixing.mixture(none(spark)).count() == 0


def test_rare_sources_cut_nothing_but_the_surplus(spark):
    sizes = {"a": 30_000, "b": 30_000, "c": 20_000, "d": 19_999, None: 1}
    even = spark.createDataFrame([(n, s) for n, s in enumerate(s for s, k in sizes.items() for _ in range(k))], "doc_id long, source string")
    assert mixing.without_surplus(even, 1, 10_000).count() == 100_000
    kept = Counter(r.source for r in mixing.without_surplus(skewed(spark), 1, 100).collect())
    assert kept == {"hot": 149, "mid": 200, "low": 90, "": 7, "one": 1}
    order = [r.doc_id for r in mixing.without_surplus(skewed(spark), 1, 100).collect()]
    places = {r.doc_id: r.place for r in mixing.mix(skewed(spark), 1, 100).collect()}
    assert order == sorted(order, key=places.get)


def test_the_pipeline_keeps_a_corpus_with_one_odd_source(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "'x' as text", "if(id = 7, null, concat('s', id % 5)) as source")
    assert corpus_pipeline.mix(spark, rows, "").count() == 3000


def many(spark, sources, rows):
    return spark.range(rows).selectExpr("id as doc_id", f"if(id % 10 = 0, 'hot', concat('s', id % {sources - 1})) as source", "'x' as text")


def test_sources_beyond_the_period_all_get_slots(spark):
    docs = many(spark, 700, 6000)
    assert docs.select("source").distinct().count() > 100
    rows = mixing.mix(docs, 1, 100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(6000)) and len({r.place for r in rows}) == 6000
    assert all(r.release <= r.slot < r.deadline for r in rows)
    assert mixing.without_surplus(docs, 1, 100).count() == 6000
    assert mixing.mixture(docs, 1, 100).count() > 0


@pytest.mark.parametrize(("sources", "steps", "levels"), [(600, None, 1.001), (2700, None, 2), (2700, 200_000, 2), (2700, 20_000, 3), (20_000, None, 2)])
def test_the_deviation_is_bounded_however_many_sources(spark, monkeypatch, sources, steps, levels):
    """Each source's share at every slot, one source with a third of all rows; trees of several levels too."""
    if steps:
        monkeypatch.setattr(mixing, "MOST_STEPS", steps)
    period = mixing.fitted(1000 if sources == 2700 else 5000, sources)
    docs = spark.range(sources * 5).selectExpr(f"if(id % 3 = 0, 'hot', concat('s', id % {sources - 1})) as source")
    weights = materialize(mixing.targets(docs, period), "weights")
    rows = mixing.schedule(weights, period).toPandas()
    assert len(rows) == period == rows.turn_slot.nunique() and (rows.groupby("_source").turn.nunique() == rows.groupby("_source").parts.first()).all()
    assert rows.sort_values("turn_slot").groupby("_source").turn.apply(lambda t: t.is_monotonic_increasing).all()
    share = rows.parts / period
    off = np.maximum((rows.turn - share * rows.turn_slot).abs(), (rows.turn + 1 - share * (rows.turn_slot + 1)).abs())
    assert off.max() < levels and off[rows._source == "hot"].max() < 1
    gaps = rows[rows._source == "hot"].turn_slot.sort_values().diff().max()
    assert gaps <= 2 / share[rows._source == "hot"].iloc[0] + 1


def test_many_sources_equal_sql(spark):
    docs = many(spark, 700, 2000)
    assert docs.select("source").distinct().count() > 500
    duck = duckdb.connect()
    duck.register("documents", docs.toPandas())
    wanted = duck.execute(mixing.oracle()).fetchdf()
    found = mixing.mix(docs).select(*wanted.columns).toPandas()
    assert sorted(map(tuple, found.values.tolist())) == sorted(map(tuple, wanted.values.tolist()))
