"""Logistic association of events with a proxy, adjusted for log references, for many settings side by side.

All settings go through Newton's method together: a step is one aggregation, by setting, of the gradient and the second
derivatives over the counted kinds of rows, and only settings that still move take part in the next. What reaches the driver is
a row of ten sums for each setting, of which there are as many as the grid that is given.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import two_sided

#: Steps at most, and a step's size at which a setting has arrived; coefficients beyond FAR have no largest likelihood: the outcomes are separated.
STEPS, NEAR, FAR = 40, 1e-10, 40.0
LEAST_ROWS = 100
_SUMS = {"g0": "sum(w * (y - m))", "g1": "sum(w * (y - m) * s)", "g2": "sum(w * (y - m) * x)", "h00": "sum(w * m * (1e0 - m))", "h01": "sum(w * m * (1e0 - m) * s)", "h02": "sum(w * m * (1e0 - m) * x)", "h11": "sum(w * m * (1e0 - m) * s * s)", "h12": "sum(w * m * (1e0 - m) * s * x)", "h22": "sum(w * m * (1e0 - m) * x * x)"}


def kinds(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, s, x and w: rows (proxy, events, n_refs, and w if they stand for several) counted by what a fit looks at. Rows without references or events are left out."""
    w = F.col("w").cast("double") if "w" in scored.columns else F.lit(1.0)
    d = scored.where((F.col("n_refs") > 0) & F.col("events").isNotNull() & F.col("proxy").isNotNull())
    one = d.select(*keys, F.when(F.col("events") > 0, 1.0).otherwise(0.0).alias("y"), F.when(F.col("proxy"), 1.0).otherwise(0.0).alias("s"), F.col("n_refs").cast("long").alias("n_refs"), w.alias("w"))
    return one.groupBy(*keys, "y", "s", "n_refs").agg(F.sum("w").alias("w")).withColumn("x", F.log(F.col("n_refs").cast("double")))


def fits(counted: DataFrame, keys: list[str], digits: int | None = None) -> DataFrame:
    """keys, n, odds_ratio, or_lo, or_hi (95 %) and p for each setting of kinds(), which is written or kept already, as it is read once a step.

    No row for settings with fewer than LEAST_ROWS rows, with one level of proxy or outcome, or with separated outcomes.
    """
    spark = counted.sparkSession
    types = dict(counted.dtypes)
    sizes = counted.groupBy(*keys).agg(F.sum("w").alias("n"), F.count_distinct("s").alias("levels"), F.count_distinct("y").alias("outcomes")).where(f"n >= {LEAST_ROWS} and levels = 2 and outcomes = 2").collect()
    key = lambda r: tuple(r[k] for k in keys)
    n, beta, errors, done = {key(r): int(r["n"]) for r in sizes}, {key(r): np.zeros(3) for r in sizes}, {}, set()
    for _ in range(STEPS):
        going = [k for k in beta if k not in done]
        if not going:
            break
        at = spark.createDataFrame([(*k, *beta[k].tolist()) for k in going], ", ".join([*(f"{k} {types[k]}" for k in keys), "b0 double", "b1 double", "b2 double"]))
        d = counted.join(F.broadcast(at), keys).withColumn("m", F.expr("1e0 / (1e0 + exp(-(b0 + b1 * s + b2 * x)))"))
        for r in d.groupBy(*keys).agg(*(F.expr(e).alias(c) for c, e in _SUMS.items())).collect():
            k = key(r)
            hessian = np.array([[r[f"h{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
            try:
                inverse = np.linalg.inv(hessian)
            except np.linalg.LinAlgError:
                inverse = np.full((3, 3), np.nan)
            step = inverse @ np.array([r["g0"], r["g1"], r["g2"]])
            if not np.isfinite(step).all() or np.abs(beta[k] + step).max() > FAR:
                done.add(k)
                continue
            beta[k] = beta[k] + step
            if np.abs(step).max() < NEAR:
                done.add(k)
                errors[k] = math.sqrt(inverse[1, 1])
    rows = [(*k, n[k], float(beta[k][1]), e) for k, e in errors.items()]
    found = spark.createDataFrame(rows, ", ".join([*(f"{k} {types[k]}" for k in keys), "n long", "b double", "e double"])).withColumn("z", F.expr("abs(b) / e"))
    out = {"odds_ratio": "exp(b)", "or_lo": "exp(b - 1.96e0 * e)", "or_hi": "exp(b + 1.96e0 * e)", "p": two_sided("z")}
    return found.select(*keys, "n", *((F.round(F.expr(e), digits) if digits else F.expr(e)).alias(c) for c, e in out.items()))


def fits_sql(rows: str, keys: list[str], steps: int = 12, digits: int = 6) -> str:
    """The common table expressions for DuckDB that end in ``fitted``, the rows of fits() over the table ``rows`` of keys, proxy, events and n_refs."""
    key = ", ".join(keys)
    text = f"""kinds AS MATERIALIZED (SELECT {key}, (events > 0)::INT::DOUBLE AS y, proxy::INT::DOUBLE AS s, ln(n_refs::DOUBLE) AS x, count(*)::DOUBLE AS w FROM {rows} WHERE n_refs > 0 AND events IS NOT NULL AND proxy IS NOT NULL GROUP BY ALL),
step0 AS (SELECT {key}, sum(w)::BIGINT AS n, 0e0 AS b0, 0e0 AS b1, 0e0 AS b2, 0e0 AS e, 1e0 AS moved FROM kinds GROUP BY {key} HAVING sum(w) >= {LEAST_ROWS} AND count(DISTINCT s) = 2 AND count(DISTINCT y) = 2)"""
    minor = {"c00": "h11 * h22 - h12 * h12", "c01": "h02 * h12 - h01 * h22", "c02": "h01 * h12 - h02 * h11", "c11": "h00 * h22 - h02 * h02", "c12": "h01 * h02 - h00 * h12", "c22": "h00 * h11 - h01 * h01"}
    for i in range(1, steps + 1):
        sums = f"SELECT {key}, n, b0, b1, b2, {', '.join(f'{e} AS {c}' for c, e in _SUMS.items())} FROM (SELECT *, 1e0 / (1e0 + exp(-(b0 + b1 * s + b2 * x))) AS m FROM step{i - 1} JOIN kinds USING ({key})) GROUP BY {key}, n, b0, b1, b2"
        solved = f"SELECT *, h00 * c00 + h01 * c01 + h02 * c02 AS det FROM (SELECT *, {', '.join(f'{e} AS {c}' for c, e in minor.items())} FROM ({sums}))"
        moves = {"d0": "(c00 * g0 + c01 * g1 + c02 * g2) / det", "d1": "(c01 * g0 + c11 * g1 + c12 * g2) / det", "d2": "(c02 * g0 + c12 * g1 + c22 * g2) / det"}
        text += f",\nstep{i} AS MATERIALIZED (SELECT {key}, n, b0 + d0 AS b0, b1 + d1 AS b1, b2 + d2 AS b2, sqrt(c11 / det) AS e, greatest(abs(d0), abs(d1), abs(d2)) AS moved FROM (SELECT *, {', '.join(f'{e} AS {c}' for c, e in moves.items())} FROM ({solved}) WHERE det > 0) WHERE greatest(abs(b0 + d0), abs(b1 + d1), abs(b2 + d2)) <= {FAR})"
    return text + f",\nfitted AS (SELECT {key}, n, round(exp(b1), {digits}) AS odds_ratio, round(exp(b1 - 1.96e0 * e), {digits}) AS or_lo, round(exp(b1 + 1.96e0 * e), {digits}) AS or_hi, round({two_sided('z')}, {digits}) AS p FROM (SELECT *, abs(b1) / e AS z FROM step{steps}) WHERE moved < 1e-6)"
