"""The exactly nearest point of any number of points in few dimensions, by pivots and the triangle inequality.

Some points are pivots; each point lies in the cell of its nearest pivot, whose least and largest distance in the cell bound
from below how near any of its points can be. A query is compared with its own cell first, then only with cells that might hold
something as near. Cells with many points or queries are split into parts that meet each other in tasks of their own, so no task
holds more than PART of either. Only the pivots and counts by cell reach the driver: at most MOST_PIVOTS rows.

Distances are rounded to six digits before they are compared; ties go to the smaller id. Points are doubles without nulls.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Pivots at most; points, or queries, of a cell that meet in one task; rounding of distances.
MOST_PIVOTS, PART, DIGITS = 2048, 20_000, 6
_AT_ONCE = 1 << 22


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all of b, squares added in the order of the dimensions."""
    total = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        total += (a[:, k, None] - b[None, :, k]) ** 2
    return np.sqrt(total)


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0))


def best_of(queries: pd.DataFrame, points: pd.DataFrame, itself: bool) -> pd.DataFrame:
    """id, far and point_id of the nearest point of each query; ties to the smaller id. itself: a query isn't compared with the point of its own id."""
    points = points.sort_values("point_id")
    ids, z = points["point_id"].to_numpy(), stacked(points["z"])
    rows: list[tuple] = []
    step = max(1, _AT_ONCE // max(1, len(points)))
    for at in range(0, len(queries), step):
        some = queries.iloc[at : at + step]
        far = np.round(apart(stacked(some["z"]), z), DIGITS)
        if itself:
            far[some["id"].to_numpy()[:, None] == ids[None, :]] = np.inf
        best = far.argmin(axis=1)
        rows += [(i, float(f), ids[b]) for i, f, b in zip(some["id"], far[np.arange(len(some)), best], best, strict=True) if math.isfinite(f)]
    return pd.DataFrame(rows, columns=["id", "far", "point_id"])


def nearest(queries: DataFrame, points: DataFrame, itself: bool = False, part: int = PART) -> DataFrame:
    """id, far and point_id: the nearest of points (point_id, z) of each of queries (id, z); without points there are no rows."""
    spark = points.sparkSession
    id_type, point_type = dict(queries.dtypes)["id"], dict(points.dtypes)["point_id"]
    count = points.count()
    if not count:
        return spark.createDataFrame([], f"id {id_type}, far double, point_id {point_type}")
    chosen = points.orderBy(F.xxhash64("point_id"), "point_id").limit(min(MOST_PIVOTS, math.isqrt(count) + 1)).collect()
    pivots, pivot_ids = np.array([r["z"] for r in chosen], float), [r["point_id"] for r in chosen]

    def to_cells(name: str):
        def run(batches):
            for rows in batches:
                if len(rows):
                    far = apart(stacked(rows["z"]), pivots)
                    cell = far.argmin(axis=1)
                    yield pd.DataFrame({name: rows[name], "z": rows["z"], "cell": cell, "r": far[np.arange(len(rows)), cell]})

        return run

    placed = staged(points.select("point_id", "z").mapInPandas(to_cells("point_id"), f"point_id {point_type}, z array<double>, cell int, r double"), "points")
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n")).collect()}
    asked = staged(queries.select("id", "z").mapInPandas(to_cells("id"), f"id {id_type}, z array<double>, cell int, r double"), "queries")
    first = staged(compared(asked.select("id", "z", "cell"), placed, cells, itself, part), "nearest")

    numbers = np.array(sorted(cells))
    low, high = (np.array([cells[c][k] for c in numbers]) for k in ("low", "high"))

    def more(batches):
        """Other cells that may hold something as near as what is known: the own cell's nearest, or a pivot."""
        for rows in batches:
            if not len(rows):
                continue
            far = apart(stacked(rows["z"]), pivots)
            bound = np.round(far, DIGITS)
            if itself:
                bound[rows["id"].to_numpy()[:, None] == np.array(pivot_ids)[None, :]] = np.inf
            known = np.minimum(rows["far"].fillna(np.inf).to_numpy(), bound.min(axis=1))
            least = np.maximum(0, np.maximum(far[:, numbers] - high, low - far[:, numbers]))
            query, which = np.nonzero((least <= known[:, None] + 10.0**-DIGITS) & (numbers[None, :] != rows["cell"].to_numpy()[:, None]))
            yield pd.DataFrame({"id": rows["id"].to_numpy()[query], "z": rows["z"].to_numpy()[query], "cell": numbers[which]})

    known = asked.join(first.select(F.col("id").alias("_id"), "far"), F.col("id") == F.col("_id"), "left").select("id", "z", "cell", "far")
    others = compared(staged(known.mapInPandas(more, f"id {id_type}, z array<double>, cell int"), "others"), placed, cells, itself, part)
    best = first.union(others).groupBy("id").agg(F.min(F.struct("far", "point_id")).alias("b"))
    return best.select("id", "b.far", "b.point_id")


def compared(asked: DataFrame, placed: DataFrame, cells: dict, itself: bool, part: int) -> DataFrame:
    """Each query (id, z, cell) against the points of that cell, in parts of bounded size."""
    spark = asked.sparkSession
    many = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    split = [(int(c), -(-cells[c]["n"] // part), -(-n // part)) for c, n in many.items() if c in cells]
    parts = F.broadcast(spark.createDataFrame(split, "cell int, points int, queries int"))  # at most MOST_PIVOTS rows
    q = asked.join(parts, "cell").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("queries")).cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("points") - 1)))
    p = placed.join(parts, "cell").withColumn("theirs", F.pmod(F.xxhash64("point_id"), F.col("points")).cast("int")).withColumn("mine", F.explode(F.sequence(F.lit(0), F.col("queries") - 1)))
    keys = ["cell", "mine", "theirs"]

    def meet(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        return best_of(queries, points, itself) if len(queries) and len(points) else pd.DataFrame([], columns=["id", "far", "point_id"])

    schema = f"id {dict(asked.dtypes)['id']}, far double, point_id {dict(placed.dtypes)['point_id']}"
    return q.select(*keys, "id", "z").groupBy(*keys).cogroup(p.select(*keys, "point_id", "z").groupBy(*keys)).applyInPandas(meet, schema)
