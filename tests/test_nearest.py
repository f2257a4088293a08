"""Nearest points by cells against all pairs."""

import numpy as np
import pytest

from reflume.operators import nearest


def frame(spark, ids, z, name):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, z, strict=True)], f"{name} long, z array<double>").repartition(3)


def brute(ids, z, point_ids, points, itself=False):
    out = {}
    order = np.argsort(point_ids)
    for i, v in zip(ids, z, strict=True):
        far = np.round(np.sqrt(((points[order] - v) ** 2).sum(1)), nearest.DIGITS)
        if itself:
            far[point_ids[order] == i] = np.inf
        best = int(far.argmin())
        out[int(i)] = (far[best], int(point_ids[order][best]))
    return out


def same(found, wanted):
    rows = {r.id: (r.far, r.point_id) for r in found.collect()}
    assert rows.keys() == wanted.keys()
    for i, (far, point) in wanted.items():
        assert abs(rows[i][0] - far) < 2e-6 and (rows[i][1] == point or rows[i][0] == far), i


def clustered(seed, count, size):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((12, size))[rng.integers(0, 12, count)] * 5 + rng.standard_normal((count, size)) * rng.choice([0.01, 0.3, 2], (count, 1))


@pytest.mark.parametrize("part", [nearest.PART, 60])
def test_equals_all_pairs(spark, part):
    points, asked = clustered(1, 2000, 7), clustered(2, 700, 7)
    points[500:1200] = points[500]  # one place has a third of them
    ids = np.random.default_rng(3).permutation(2000) * 3
    same(nearest.nearest(frame(spark, range(700), asked, "id"), frame(spark, ids, points, "point_id"), part=part), brute(range(700), asked, ids, points))
    found = nearest.nearest(frame(spark, ids, points, "id"), frame(spark, ids, points, "point_id"), itself=True, part=part)
    same(found, brute(ids, points, ids, points, itself=True))
    assert found.where("id = point_id").isEmpty()


def test_ties_few_points_and_none(spark):
    grid = np.array([[x, y] for x in range(12) for y in range(12)], float)
    asked = grid[::5] + 0.5
    found = nearest.nearest(frame(spark, range(len(asked)), asked, "id"), frame(spark, range(144), grid, "point_id"))
    assert {r.id: (r.far, r.point_id) for r in found.collect()} == brute(range(len(asked)), asked, np.arange(144), grid)
    one = frame(spark, [4], np.array([[1.0, 2.0]]), "point_id")
    q = frame(spark, [4, 5], np.array([[1.0, 2.0], [4.0, 6.0]]), "id")
    assert sorted((r.id, r.far, r.point_id) for r in nearest.nearest(q, one).collect()) == [(4, 0.0, 4), (5, 5.0, 4)]
    assert [r.id for r in nearest.nearest(q, one, itself=True).collect()] == [5]
    assert nearest.nearest(q, one.limit(0)).count() == 0 and nearest.nearest(q.limit(0), one).count() == 0


def test_many_points(spark, tmp_path):
    """200,000 points, of which few are compared with each query."""
    rows = spark.range(200_000).selectExpr("id as point_id", "array(randn(5), randn(6), randn(7), randn(8) * 3) as z")
    rows.write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    known = points.toPandas()
    asked = clustered(4, 120, 4) / 5
    same(nearest.nearest(frame(spark, range(120), asked, "id"), points), brute(range(120), asked, known["point_id"].to_numpy(), np.stack(known["z"])))
