"""Identifiers, dates, inverted indexes, vocabularies: hand-made cases."""

import datetime

from pyspark.sql import functions as F

from reflume.config import MARKERS
from reflume.functions import scalars


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_norm_doi(spark):
    given = ["https://doi.org/10.1000/ABC", "doi:10.1/x", None, "", "10.1021/acs.jafc.2c04673?ref=article_openpdf", " HTTP://DX.DOI.ORG/10.5/y#s ", "10.1/z.,;)", "https://doi.org/doi:10.9/q"]
    assert column(spark, given, scalars.norm_doi) == ["10.1000/abc", "10.1/x", None, None, "10.1021/acs.jafc.2c04673", "10.5/y", "10.1/z", "10.9/q"]


def test_short_id_and_prefix(spark):
    assert column(spark, ["https://a.example/W1", "W2", "", None], scalars.short_id) == ["W1", "W2", None, None]
    assert column(spark, ["123456789012345678901W7"], scalars.without_prefix) == ["W7"]


def test_inverted_text(spark):
    given = [{"world": [1], "hello": [0]}, None, {}, {"a": [0, 2], "b": [1, 2]}]
    assert column(spark, given, scalars.inverted_text, "map<string,array<int>>") == ["hello world", "", "", "a b b"]


def test_inverted_index(spark):
    given = [["b", "a", "b"], [], None, ["\u00e9"], [str(i % 97) for i in range(20_000)]]
    whole = {str(i): list(range(i, 20_000, 97)) for i in range(97)}
    assert column(spark, given, scalars.inverted_index, "array<string>") == [{"a": [1], "b": [0, 2]}, {}, None, {"\u00e9": [0]}, whole]


def test_stable_fraction(spark):
    found = column(spark, ["openalex/data/parquet/works/part_0000.parquet", None], scalars.stable_fraction)
    assert abs(found[0] - 0.16529035) < 1e-6 and found[1] is None


def test_dates(spark):
    d = datetime.date
    assert column(spark, ["3/4/2020 0:00", "2020-03-04", "n/a", "", None], scalars.parse_date) == [d(2020, 3, 4), d(2020, 3, 4), None, None, None]
    assert column(spark, [d(2020, 8, 31)], lambda c: scalars.eligible_from(c, 6), "date") == [d(2021, 2, 28)]
    assert column(spark, [d(1970, 1, 2)], scalars.epoch_days, "date") == [1]


def test_marker_score(spark):
    given = ["we delve into the intricate realm", "we measured the wheat yield", '{"delve": [0], "intricate": [1], "realm,": [2]}', '{"wheat": [0]}', None, "", "{not json delve"]
    assert column(spark, given, lambda c: scalars.marker_score(c, MARKERS)) == [3, 0, 3, 0, 0, 0, 1]


def test_names_and_reasons(spark):
    assert column(spark, ["a", "", None], scalars.named) == ["a", "Unknown", "Unknown"]
    assert column(spark, ["+x;+y; ", None], scalars.clean_reason) == ["x;+y", None]
