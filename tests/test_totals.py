"""Totals that survive ends between files, in the middle of a batch and after its sums are written."""

import pytest
from pyspark.sql import functions as F

from reflume.streaming import totals
from reflume.streaming.totals import Totals

ROWS = "id long, month string, n long"


def arriving(spark, folder, files=6, rows=10):
    for n in range(files):
        spark.range(rows * n, rows * n + rows).selectExpr("id", "concat('m', id % 4) as month", "id * 3 as n").coalesce(1).write.mode("append").parquet(folder)


def sums(batch):
    return batch.groupBy("month").agg(F.sum("n").alias("n"), F.count("*").alias("works"))


def made(spark, tmp_path, name):
    return Totals(spark, str(tmp_path / name), "month string, n long, works long", ("month",))


def rows_of(t):
    return sorted(map(tuple, t.read().collect()))


def wanted(count):
    return [(f"m{k}", sum(3 * i for i in range(count) if i % 4 == k), sum(1 for i in range(count) if i % 4 == k)) for k in range(4)]


def schema(spark):
    return spark.createDataFrame([], ROWS).schema


@pytest.mark.parametrize("where", ["before", "middle", "after"])
def test_a_killed_run_is_gone_on_with(spark, tmp_path, monkeypatch, where):
    """The third batch ends before its sums are written, with half of them, or after them but before the stream says so."""
    files, t, calls = str(tmp_path / "in"), made(spark, tmp_path, "out"), []
    arriving(spark, files)
    plain = totals.written

    def killed(rows, path):
        calls.append(path)
        if len(calls) == 3:
            if where != "before":
                plain(rows if where == "after" else rows.limit(1), path)
            raise RuntimeError("killed")
        plain(rows, path)

    monkeypatch.setattr(totals, "written", killed)
    with pytest.raises(Exception, match="killed"):
        t.add(schema(spark), files, sums, files_at_once=1)
    assert t.done() == [0, 1] and rows_of(t) == wanted(20) or len(t.done()) == 2
    assert sum(r[2] for r in rows_of(t)) == 20
    assert t.add(schema(spark), files, sums, files_at_once=1)
    assert calls[2] == calls[3] and len(calls) == 7  # the same batch again, in its place
    whole = made(spark, tmp_path, "whole")
    assert whole.add(schema(spark), files, sums)
    assert rows_of(t) == rows_of(whole) == wanted(60)


def test_merged_batches_and_new_files(spark, tmp_path):
    files, t = str(tmp_path / "in"), made(spark, tmp_path, "out")
    assert rows_of(t) == [] and t.done() == []
    t.compact()
    arriving(spark, files, 3)
    assert t.add(schema(spark), files, sums, files_at_once=1)
    t.compact()
    t.compact()
    assert rows_of(t) == wanted(30) and sorted(n for n in t._names("") if n != "progress") == ["base-2"]
    spark.range(30, 40).selectExpr("id", "concat('m', id % 4) as month", "id * 3 as n").write.mode("append").parquet(files)
    assert t.add(schema(spark), files, sums) and t.add(schema(spark), files, sums)
    assert rows_of(t) == wanted(40)
    (tmp_path / "out" / "base-9").mkdir()  # a base that isn't whole doesn't count
    assert rows_of(t) == wanted(40)


def test_a_scan_cut_by_its_deadline_equals_one_uncut(spark, tmp_path):
    files, t = str(tmp_path / "in"), made(spark, tmp_path, "out")
    arriving(spark, files, 8)
    assert not t.add(schema(spark), files, sums, files_at_once=1, seconds=0.01)
    cut = 1
    while not t.add(schema(spark), files, sums, files_at_once=1, seconds=3):
        cut += 1
        assert cut < 60
    assert rows_of(t) == wanted(80)
