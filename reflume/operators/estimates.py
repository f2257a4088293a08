"""Bootstrap ratios and bounds under misclassification; breaks.py and logits.py hold the fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import HAC_LAGS, SENSITIVITIES, SPECIFICITIES
from ..functions import scalars
from ..session import staged

def hac_terms(residuals: DataFrame, lags: int = HAC_LAGS) -> DataFrame:
    """Weighted sums of a moment column u with its own lags, in the order of t, as the HAC meat of one regressor."""
    order = Window.orderBy("t")  # one row for each month
    terms = F.col("u") * F.col("u")
    for lag in range(1, lags + 1):
        terms = terms + 2 * (1 - lag / (lags + 1)) * F.coalesce(F.col("u") * F.lag("u", lag).over(order), F.lit(0.0))
    return residuals.withColumn("term", terms).agg(F.sum("term").alias("meat"), F.count("*").alias("n"))


#: Kinds of rows that one task of the bootstrap draws.
KINDS_AT_ONCE = 50_000


def bootstrap_ratio(rows: DataFrame, replicates: int = 10_000, seed: int = 11, at_once: int = KINDS_AT_ONCE) -> DataFrame:
    """Ratio of the two groups' rates (group, events, of) and its 2.5 and 97.5 percentiles when rows are resampled.

    Rows that are alike are counted first, and a replicate draws how often each kind occurs, which is the same as drawing
    rows. Kinds are dealt to buckets: each replicate's rows are divided among the buckets once, in a table, and every bucket then
    draws its own kinds from its part, so any number of them can be resampled. What reaches the driver is a count for each bucket.
    """
    spark = rows.sparkSession
    given = rows.where("events is not null and of is not null and group in ('artifact', 'control')").select("group", F.col("events").cast("double").alias("events"), F.col("of").cast("double").alias("of"))
    kinds = staged(given.groupBy("group", "events", "of").agg(F.count("*").alias("n")), "kinds")
    buckets = max(1, -(-kinds.count() // at_once))
    kinds = kinds.withColumn("bucket", F.pmod(F.xxhash64("events", "of"), F.lit(buckets)))
    sums = kinds.groupBy("group", "bucket").agg(F.sum("n").alias("n"), F.sum(F.col("events") * F.col("n")).alias("events"), F.sum(F.col("of") * F.col("n")).alias("of")).orderBy("group", "bucket").collect()
    whole = {g: [r for r in sums if r["group"] == g] for g in ("artifact", "control")}
    if not all(whole.values()):
        return spark.createDataFrame([], "rate_artifact double, rate_control double, ratio double, ratio_lo double, ratio_hi double, n_artifact long, n_control long")
    sizes = {g: ([r["bucket"] for r in found], np.array([r["n"] for r in found], float)) for g, found in whole.items()}

    def divided(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"]:
                for group, (numbers, counts) in sizes.items():
                    own = np.random.Generator(np.random.PCG64([seed, i, ord(group[0])])).multinomial(int(counts.sum()), counts / counts.sum())
                    yield pd.DataFrame({"group": group, "bucket": numbers, "i": i, "own": own})

    def drawn(kind: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        group, bucket = kind["group"].iloc[0], int(kind["bucket"].iloc[0])
        kind, parts = kind.sort_values(["events", "of"]), parts.sort_values("i")
        values, share = kind[["events", "of"]].to_numpy(float), kind["n"].to_numpy(float)
        out = np.array([np.random.Generator(np.random.PCG64([seed, i, ord(group[0]), bucket])).multinomial(own, share / share.sum()) @ values for i, own in zip(parts["i"], parts["own"], strict=True)])
        return pd.DataFrame({"i": parts["i"].to_numpy(), "group": group, "events": out[:, 0], "of": out[:, 1]})

    parts = spark.range(replicates).mapInPandas(divided, "group string, bucket long, i long, own long")
    each = kinds.groupBy("group", "bucket").cogroup(parts.groupBy("group", "bucket")).applyInPandas(drawn, "i long, group string, events double, of double").groupBy("i")

    def rate(g: str) -> Column:
        return F.sum(F.when(F.col("group") == g, F.col("events"))) / F.nullif(F.sum(F.when(F.col("group") == g, F.col("of"))), F.lit(0.0))

    def known(g: str) -> float:
        of = sum(r["of"] for r in whole[g])
        return sum(r["events"] for r in whole[g]) / of * 1000 if of else float("nan")

    a, c = known("artifact"), known("control")
    ratios = each.agg((rate("artifact") / F.nullif(rate("control"), F.lit(0.0))).alias("ratio"))
    return ratios.agg(F.percentile("ratio", F.lit(0.025)).alias("ratio_lo"), F.percentile("ratio", F.lit(0.975)).alias("ratio_hi")).select(
        F.lit(a).alias("rate_artifact"), F.lit(c).alias("rate_control"), F.lit(a / c if c else None).cast("double").alias("ratio"), "ratio_lo", "ratio_hi",
        *(F.lit(int(sizes[g][1].sum())).cast("long").alias(f"n_{g}") for g in ("artifact", "control")),
    )


def bound_inputs(scored: DataFrame, keys: list[str], least: int = 0) -> DataFrame:
    """n, share of proxy positives, event rates and mean denominators on either side of the proxy."""
    d = scored.where((F.col("n_refs") > 0) & (F.col("n_refs") >= least) & F.col("events").isNotNull())
    y = F.when(F.col("events") > 0, 1.0).otherwise(0.0)
    return d.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("proxy"), 1.0).otherwise(0.0)).alias("p_s1"),
        F.avg(F.when(F.col("proxy"), y)).alias("p_y_s1"),
        F.avg(F.when(~F.col("proxy"), y)).alias("p_y_s0"),
        F.avg(F.when(F.col("proxy"), F.col("n_refs"))).alias("mean_refs_s1"),
        F.avg(F.when(~F.col("proxy"), F.col("n_refs"))).alias("mean_refs_s0"),
    )


def corrected(inputs: DataFrame) -> DataFrame:
    """inputs (p_y_s1, p_y_s0, p_s1, sens, spec) with q and the true rates a and b where the pair is feasible, else without the row."""
    j = F.col("sens") + F.col("spec") - 1
    d = inputs.withColumn("j", j).where(F.abs("j") >= 1e-9).withColumn("q", (F.col("p_s1") - (1 - F.col("spec"))) / F.col("j")).where("q > 0 and q < 1")
    r1, r0 = F.col("p_y_s1") * F.col("p_s1"), F.col("p_y_s0") * (1 - F.col("p_s1"))
    a = (F.col("spec") * r1 - (1 - F.col("spec")) * r0) / (F.col("q") * F.col("j"))
    b = (F.col("sens") * r0 - (1 - F.col("sens")) * r1) / ((1 - F.col("q")) * F.col("j"))
    d = d.withColumn("a", a).withColumn("b", b).where("a between -0.05 and 1.05 and b between -0.05 and 1.05")
    return d.withColumn("a", scalars.clip(F.col("a"))).withColumn("b", scalars.clip(F.col("b"))).drop("j")


def grid(spark, sens: list[float] = SENSITIVITIES, spec: list[float] = SPECIFICITIES) -> DataFrame:
    return spark.createDataFrame([(float(a), float(b)) for a in sens for b in spec], "sens double, spec double")


def bounds(inputs: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Least and largest true rates over the feasible pairs; inputs without any keep their row."""
    solved = corrected(inputs.crossJoin(F.broadcast(pairs)))  # pairs: a short grid
    ends = solved.groupBy(*keys).agg(F.min("a").alias("a_lo"), F.max("a").alias("a_hi"), F.min("b").alias("b_lo"), F.max("b").alias("b_hi"), F.count("*").alias("n_feasible"))
    if keys:
        return inputs.join(ends, keys, "left").withColumn("n_feasible", F.coalesce("n_feasible", F.lit(0)))
    return inputs.crossJoin(ends)


def interval_bars(rows: DataFrame, label: str, series: dict[str, tuple[str, str]]) -> DataFrame:
    """label, series, lo and hi in percent: a bar for each row and series whose ends (columns) are known."""
    bars = F.array(*(F.struct(F.lit(name).alias("series"), F.round(F.col(lo) * 100, 4).alias("lo"), F.round(F.col(hi) * 100, 4).alias("hi")) for name, (lo, hi) in series.items()))
    return rows.select(F.col(label).alias("label"), F.explode(bars).alias("b")).select("label", "b.*").where("lo is not null")


def error_bars(ratios: DataFrame) -> DataFrame:
    """label, ratio and how far its interval reaches below and above it, of (label, ratio, ratio_lo, ratio_hi)."""
    return ratios.where("ratio is not null").select("label", "ratio", (F.col("ratio") - F.col("ratio_lo")).alias("below"), (F.col("ratio_hi") - F.col("ratio")).alias("above"))
