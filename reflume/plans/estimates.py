"""Queries on time-series breaks, bootstrap ratios, bounds, association and precision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..operators import breaks, citations, estimates, logits
from ..session import staged
from ..sources import standins
from ..sources.standins import SQL
from . import citations as late
from . import cohorts
from .identifiers import WORDS
from .queries import ORACLES, query

FIRST, LAST, BREAK = "1995-01", "2001-07", 48
SENS, SPEC = [0.3, 0.5, 0.7, 0.9], [0.8, 0.9, 0.95, 0.99]


def numbered(spark: SparkSession, d: str, keys: list[str]) -> DataFrame:
    """The series by month (t) and keys, on the spine."""
    spine = citations.month_spine(spark, FIRST, LAST).withColumn("t", F.row_number().over(Window.orderBy("month")) - 1)  # a row for each month
    return spine.join(citations.series(late.counted(spark, d), ["month", *keys]), "month", "left" if not keys else "inner")


_Y = SQL + f""", spine AS (SELECT row_number() OVER (ORDER BY m) - 1 AS t, strftime(m, '%Y-%m') AS month FROM range(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH) r(m)),
y AS (SELECT t, rate FROM spine LEFT JOIN (SELECT month, round(sum(late)::DOUBLE / sum(n_refs) * 10000, 6) AS rate FROM counted GROUP BY 1) USING (month)),
u AS (SELECT t, rate - (SELECT avg(rate) FROM y) AS u FROM y WHERE rate IS NOT NULL)
"""


def _fitted(points: str, keys: list[str], columns: str = "*") -> str:
    return f"{_Y.rstrip()}, {points},\n{breaks.fits_sql('points', keys)} SELECT {columns} FROM fitted"


@query(_fitted(f"points AS (SELECT 'pooled' AS series, t, rate, {BREAK} AS break_at FROM y)", ["series"]))
def its_fit(spark: SparkSession, d: str) -> DataFrame:
    return breaks.fits(numbered(spark, d, []).withColumn("series", F.lit("pooled")).withColumn("break_at", F.lit(BREAK)), ["series"])


@query(_fitted(f"points AS (SELECT b.break_at::INT AS break_at, t, rate FROM y, range(6, {BREAK - 5}) b(break_at) WHERE t < {BREAK})", ["break_at"], "break_at, level_change"))
def its_placebo(spark: SparkSession, d: str) -> DataFrame:
    moved = spark.range(6, BREAK - 5).select(F.col("id").cast("int").alias("break_at"))
    rows = numbered(spark, d, []).where(F.col("t") < BREAK).crossJoin(F.broadcast(moved))  # months by break months
    return breaks.fits(rows, ["break_at"]).select("break_at", "level_change")


_BY_FIELD = f"""top AS (SELECT field FROM counted JOIN spine USING (month) GROUP BY 1 ORDER BY sum(late) DESC, field LIMIT 8),
points AS (SELECT field, t, round(sum(late)::DOUBLE / nullif(sum(n_refs), 0) * 10000, 6) AS rate, {BREAK} AS break_at FROM counted JOIN spine USING (month) WHERE field IN (SELECT field FROM top) GROUP BY 1, 2)"""


@query(_fitted(_BY_FIELD, ["field"]))
def its_by_field(spark: SparkSession, d: str) -> DataFrame:
    series = numbered(spark, d, ["field"])
    top = series.groupBy("field").agg(F.sum("events").alias("n")).orderBy(F.desc("n"), "field").limit(8)
    return breaks.fits(series.join(top.select("field"), "field", "left_semi").withColumn("break_at", F.lit(BREAK)), ["field"])


@query(_fitted(f'points AS (SELECT e."end"::INT AS "end", t, rate, {BREAK} AS break_at FROM y, (VALUES (72), (74), (76), (78)) e("end") WHERE t <= e."end")', ['"end"']))
def its_truncation(spark: SparkSession, d: str) -> DataFrame:
    ends = spark.createDataFrame([(72,), (74,), (76,), (78,)], "end int")
    rows = numbered(spark, d, []).crossJoin(F.broadcast(ends)).where("t <= end").withColumn("break_at", F.lit(BREAK))
    return breaks.fits(rows, ["end"])


@query(_Y + "SELECT round(sum(term), 4) AS meat, count(*) AS n FROM (SELECT u * u" + "".join(f" + 2 * (1 - {lag} / 7.0::DOUBLE) * coalesce(u * lag(u, {lag}) OVER (ORDER BY t), 0)" for lag in range(1, 7)) + " AS term FROM u)")
def its_hac_sql(spark: SparkSession, d: str) -> DataFrame:
    y = numbered(spark, d, []).where("rate is not null")
    centred = y.crossJoin(y.agg(F.avg("rate").alias("m"))).select("t", (F.col("rate") - F.col("m")).alias("u"))
    return estimates.hac_terms(centred).withColumn("meat", F.round("meat", 4))


#: Placebo level changes as given values: the month's rate against the series' mean.
_GIVEN = _Y.rstrip() + ", given AS (SELECT t, round(u, 6) AS x FROM u WHERE t < 48)\n"


def given(spark: SparkSession, d: str) -> DataFrame:
    y = numbered(spark, d, []).where("rate is not null")
    return y.crossJoin(y.agg(F.avg("rate").alias("m"))).where("t < 48").select("t", F.round(F.col("rate") - F.col("m"), 6).alias("x"))


@query(_GIVEN + "SELECT round(avg(CASE WHEN abs(x) < 30 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share, max(abs(x)) AS largest FROM given")
def placebo_share(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, d).agg(F.round(F.avg((F.abs("x") < 30).cast("double")), 6).alias("share"), F.max(F.abs("x")).alias("largest"))


@query(_GIVEN + "SELECT least(floor((x - lo) / (hi - lo) * 12), 11)::BIGINT AS bin, count(*) AS n FROM given, (SELECT min(x) AS lo, max(x) AS hi FROM given) GROUP BY 1")
def placebo_histogram(spark: SparkSession, d: str) -> DataFrame:
    x = given(spark, d)
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    spot = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 12), F.lit(11))
    return x.crossJoin(ends).groupBy(spot.cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    works = cohorts.counted(spark, d)
    rows = works.where("n_refs > 0").join(cohorts.papers(works), "id")
    return estimates.bootstrap_ratio(rows.select("group", F.col("late").alias("events"), F.col("n_refs").alias("of")))


_INPUTS = """count(*) AS n, avg(CASE WHEN proxy THEN 1.0::DOUBLE ELSE 0 END) AS p_s1, avg(CASE WHEN proxy THEN (events > 0)::INT::DOUBLE END) AS p_y_s1, avg(CASE WHEN NOT proxy THEN (events > 0)::INT::DOUBLE END) AS p_y_s0,
avg(CASE WHEN proxy THEN n_refs END) AS mean_refs_s1, avg(CASE WHEN NOT proxy THEN n_refs END) AS mean_refs_s0"""
_GRID = "(SELECT a.v AS sens, b.v AS spec FROM (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in SENS) + ") a(v), (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in SPEC) + ") b(v))"


def _solved(inputs: str) -> str:
    return f"""solved AS (SELECT *, greatest(0, least(1, (spec * r1 - (1 - spec) * r0) / (q * j))) AS a, greatest(0, least(1, (sens * r0 - (1 - sens) * r1) / ((1 - q) * j))) AS b
FROM (SELECT *, (p_s1 - (1 - spec)) / j AS q, p_y_s1 * p_s1 AS r1, p_y_s0 * (1 - p_s1) AS r0 FROM (SELECT *, sens + spec - 1 AS j FROM ({inputs}) i, {_GRID} g) WHERE abs(j) >= 1e-9)
WHERE q > 0 AND q < 1 AND (spec * r1 - (1 - spec) * r0) / (q * j) BETWEEN -0.05 AND 1.05 AND (sens * r0 - (1 - sens) * r1) / ((1 - q) * j) BETWEEN -0.05 AND 1.05)"""


def rounded(d: DataFrame, names: list[str]) -> DataFrame:
    return reduce(lambda x, n: x.withColumn(n, F.round(n, 6)), names, d)


@query(SQL + f", {_solved(f'SELECT {_INPUTS} FROM scored WHERE n_refs > 0')} SELECT sens, spec, round(q, 6) AS q, round(a, 6) AS a, round(b, 6) AS b FROM solved")
def bounds_grid(spark: SparkSession, d: str) -> DataFrame:
    inputs = estimates.bound_inputs(standins.scored(spark, d), [])
    return rounded(estimates.corrected(inputs.crossJoin(F.broadcast(estimates.grid(spark, SENS, SPEC)))).select("sens", "spec", "q", "a", "b"), ["q", "a", "b"])


@query(SQL + f", inputs AS (SELECT {_INPUTS} FROM scored WHERE n_refs >= 20), {_solved('SELECT * FROM inputs')} SELECT n, round(p_s1, 6) AS p_s1, round(p_y_s1, 6) AS p_y_s1, round(p_y_s0, 6) AS p_y_s0, round(mean_refs_s1, 6) AS mean_refs_s1, round(mean_refs_s0, 6) AS mean_refs_s0, (SELECT round(min(a), 6) FROM solved) AS a_lo, (SELECT round(max(a), 6) FROM solved) AS a_hi, (SELECT round(min(b), 6) FROM solved) AS b_lo, (SELECT round(max(b), 6) FROM solved) AS b_hi, (SELECT count(*) FROM solved) AS n_feasible FROM inputs")
def bound_outcome(spark: SparkSession, d: str) -> DataFrame:
    found = estimates.bounds(estimates.bound_inputs(standins.scored(spark, d), [], 20), estimates.grid(spark, SENS, SPEC), [])
    return rounded(found, ["p_s1", "p_y_s1", "p_y_s0", "mean_refs_s1", "mean_refs_s0", "a_lo", "a_hi", "b_lo", "b_hi"])


_STRATUM = "CASE WHEN n_refs < 20 THEN NULL WHEN n_refs < 40 THEN '20-40' WHEN n_refs < 60 THEN '40-60' WHEN n_refs < 100 THEN '60-100' ELSE '100+' END"


@query(SQL + f", inputs AS (SELECT * FROM (SELECT {_STRATUM} AS stratum, {_INPUTS}, count(*) FILTER (proxy AND events > 0) AS events_s1, count(*) FILTER (NOT proxy AND events > 0) AS events_s0 FROM scored GROUP BY 1) WHERE stratum IS NOT NULL), {_solved('SELECT * FROM inputs')} SELECT i.stratum, any_value(i.n) AS n, any_value(i.events_s1) AS events_s1, any_value(i.events_s0) AS events_s0, round(min(a), 6) AS a_lo, round(max(a), 6) AS a_hi, count(a) AS n_feasible FROM inputs i LEFT JOIN solved s ON s.stratum = i.stratum GROUP BY 1")
def bounds_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    rows = standins.scored(spark, d).withColumn("stratum", F.expr(_STRATUM)).where("stratum is not null")
    counts = rows.groupBy("stratum").agg(F.count_if(F.col("proxy") & (F.col("events") > 0)).alias("events_s1"), F.count_if(~F.col("proxy") & (F.col("events") > 0)).alias("events_s0"))
    found = estimates.bounds(estimates.bound_inputs(rows, ["stratum"]), estimates.grid(spark, SENS, SPEC), ["stratum"]).join(counts, "stratum")
    return rounded(found.select("stratum", "n", "events_s1", "events_s0", "a_lo", "a_hi", "n_feasible"), ["a_lo", "a_hi"])


@query(SQL + f", rows_ AS (SELECT 0 AS min_refs, * FROM scored), {logits.fits_sql('rows_', ['min_refs'])} SELECT n, odds_ratio, or_lo, or_hi, p, min_refs::BIGINT AS min_refs FROM fitted")
def logit_adjusted(spark: SparkSession, d: str) -> DataFrame:
    counted = staged(logits.kinds(standins.scored(spark, d).withColumn("min_refs", F.lit(0).cast("long")), ["min_refs"]), "kinds")
    return logits.fits(counted, ["min_refs"], 6).select("n", "odds_ratio", "or_lo", "or_hi", "p", "min_refs")


_SETTINGS = [(markers, least) for markers in (3, 4, 5) for least in (10, 20, 30, 40)]
_SWEEP = f"""WITH s AS (SELECT score, quality::BIGINT AS events, floor(n_chars / 50)::BIGINT AS n_refs FROM ({ORACLES['lexical_score']}) JOIN labels USING (doc_id) JOIN documents USING (doc_id)),
settings AS (SELECT * FROM (VALUES {', '.join(map(str, _SETTINGS))}) v(markers, min_refs)), rows_ AS (SELECT markers, min_refs, score >= markers AS proxy, events, n_refs FROM s, settings WHERE n_refs >= min_refs)"""


@query(f"{_SWEEP}, {logits.fits_sql('rows_', ['markers', 'min_refs'])} SELECT n, odds_ratio, or_lo, or_hi, p, min_refs::BIGINT AS min_refs, markers::INT AS markers FROM fitted")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The association under twelve settings of marker words and references, fitted together."""
    docs = standins.table(spark, d, "documents").join(standins.table(spark, d, "labels"), "doc_id")
    rows = docs.select(scalars.marker_score(F.col("text"), WORDS).alias("score"), F.col("quality").cast("long").alias("events"), F.floor(F.col("n_chars") / 50).cast("long").alias("n_refs"))
    counted = rows.groupBy("score", "events", "n_refs").agg(F.count("*").alias("w"))  # each text is scored once, for all settings
    settings = F.broadcast(spark.createDataFrame(_SETTINGS, "markers int, min_refs long"))
    of_setting = counted.join(settings, F.col("n_refs") >= F.col("min_refs")).withColumn("proxy", F.col("score") >= F.col("markers"))
    found = logits.fits(staged(logits.kinds(of_setting, ["markers", "min_refs"]), "kinds"), ["markers", "min_refs"], 6)
    return found.select("n", "odds_ratio", "or_lo", "or_hi", "p", "min_refs", "markers")


@query("""SELECT n, n_clear, hits, round(hits / n::DOUBLE, 6) AS strict, round(hits / n_clear::DOUBLE, 6) AS precision,
round(hits / n_clear::DOUBLE - 1.96::DOUBLE * sqrt(hits / n_clear::DOUBLE * (1 - hits / n_clear::DOUBLE) / n_clear), 6) AS lo, round(hits / n_clear::DOUBLE + 1.96::DOUBLE * sqrt(hits / n_clear::DOUBLE * (1 - hits / n_clear::DOUBLE) / n_clear), 6) AS hi
FROM (SELECT count(*) AS n, count(*) FILTER (toxic = 0) AS n_clear, count(*) FILTER (toxic = 0 AND quality = 1) AS hits FROM labels)""")
def precision_estimate(spark: SparkSession, d: str) -> DataFrame:
    c = standins.table(spark, d, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 0).alias("n_clear"), F.count_if((F.col("toxic") == 0) & (F.col("quality") == 1)).alias("hits"))
    p = F.col("hits") / F.col("n_clear")
    half = 1.96 * F.sqrt(p * (1 - p) / F.col("n_clear"))
    return c.select("n", "n_clear", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("strict"), F.round(p, 6).alias("precision"), F.round(p - half, 6).alias("lo"), F.round(p + half, 6).alias("hi"))
