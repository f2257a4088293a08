"""Interrupted time series by moments: a line before and a line after the break, whose errors allow for serial correlation.

Level, trend, level change and slope change by least squares are two lines, one on either side of the break, as nothing of the
one side enters the other's normal equations. So a fit takes counts, sums and sums of products by side, which one
aggregation gives for any number of series, breaks and ends side by side. Each month's part in an estimate is its weight there
times its residual; the heteroskedasticity and autocorrelation consistent variance is the sum of these parts' products with each
other up to some months apart, with Bartlett's weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import HAC_LAGS, LEAST_MONTHS
from ..functions.normal import two_sided

#: Sums by side, in the order in which they build on each other, alike in both dialects. x is months after the break.
_SIDES = {"n": "count(*)", "sx": "sum(x)", "sy": "sum(rate)", "sxx": "sum(x * x)", "sxy": "sum(x * rate)"}
_LINE = {"dxx": "sxx - sx * sx / n", "slope": "(sxy - sx * sy / n) / nullif(dxx, 0e0)", "level": "sy / n - slope * sx / n", "sign": "CASE WHEN post THEN 1e0 ELSE -1e0 END", "off": "rate - level - slope * x", "tilt": "(x - sx / n) / nullif(dxx, 0e0)", "u": "sign * (1e0 / n - sx / n * tilt) * off", "v": "sign * tilt * off"}
_OUT = {"level_change": "max(CASE WHEN post THEN level END) - max(CASE WHEN NOT post THEN level END)", "slope_change": "max(CASE WHEN post THEN slope END) - max(CASE WHEN NOT post THEN slope END)", "pre_mean_rate": "max(CASE WHEN NOT post THEN sy / n END)", "n_months": "count(*)", "level_var": "sum(uu)", "slope_var": "sum(vv)"}
NAMES = ["level_change", "level_change_se", "level_change_p", "slope_change", "slope_change_se", "slope_change_p", "pre_mean_rate", "n_months"]


def lagged(name: str, lags: int, lag: str) -> str:
    """The column's square and twice its weighted products with the rows before; ``lag`` is how a row before is written."""
    return f"{name} * {name}" + "".join(f" + 2e0 * (1e0 - {k}e0 / {lags + 1}e0) * coalesce({name} * {lag.format(name=name, k=k)}, 0e0)" for k in range(1, lags + 1))


def fits(series: DataFrame, keys: list[str], lags: int = HAC_LAGS, least: int = LEAST_MONTHS, digits: int = 9) -> DataFrame:
    """A fit for each value of the keys. series: keys, t (months from 0), rate and break_at, a row for each month.

    Months without a rate leave the fit; lags count the months that are there. Series with fewer than ``least`` months, or fewer than two on a side of the
    break, have no row.
    """
    d = series.where("rate is not null and not isnan(rate)").select(*keys, "t", F.col("rate").cast("double").alias("rate"), (F.col("t") >= F.col("break_at")).alias("post"), (F.col("t") - F.col("break_at")).cast("double").alias("x"))
    d = d.repartition(*keys)  # both windows and the sums need no other shuffle
    side = Window.partitionBy(*keys, "post")
    d = d.withColumns({c: F.expr(e).over(side) for c, e in _SIDES.items()})
    for c, e in _LINE.items():
        d = d.withColumn(c, F.expr(e))
    before = Window.partitionBy(*keys).orderBy("t")
    at = [f"{c}{k}" for c in "uv" for k in range(1, lags + 1)]
    d = d.withColumns({c: F.lag(c[0], int(c[1:])).over(before) for c in at})
    d = d.withColumns({c * 2: F.expr(lagged(c, lags, "{name}{k}")) for c in "uv"})
    found = d.groupBy(*keys).agg(*(F.expr(e).alias(c) for c, e in _OUT.items())).where((F.col("n_months") >= least) & F.col("level_change").isNotNull())
    return with_errors(found, keys, digits)


def with_errors(found: DataFrame, keys: list[str], digits: int) -> DataFrame:
    for c in ("level", "slope"):
        found = found.withColumn(f"{c}_change_se", F.expr(f"sqrt({c}_var)")).withColumn("z", F.expr(f"abs({c}_change) / nullif({c}_change_se, 0e0)")).withColumn(f"{c}_change_p", F.expr(two_sided("z")))
    return found.select(*keys, *(F.expr(rounded(n, digits)).alias(n) for n in NAMES[:-1]), F.col("n_months").cast("long").alias("n_months"))


def rounded(name: str, digits: int) -> str:
    """Rounding that takes what lies a few last bits below a half for a half: means of rounded rates often are one, and engines add in other orders."""
    return f"round({name} * 1.000000000001e0, {digits})"


def fits_sql(points: str, keys: list[str], lags: int = HAC_LAGS, least: int = LEAST_MONTHS, digits: int = 9) -> str:
    """The common table expressions for DuckDB that end in ``fitted``, the rows of fits() over the table ``points``."""
    key = ", ".join(keys)
    text = f"""side AS (SELECT {key}, t, rate::DOUBLE AS rate, t >= break_at AS post, (t - break_at)::DOUBLE AS x FROM {points} WHERE rate IS NOT NULL),
line0 AS (SELECT *, {', '.join(f'{e} OVER (PARTITION BY {key}, post) AS {c}' for c, e in _SIDES.items())} FROM side)"""
    last = "line0"
    for i, (c, e) in enumerate(_LINE.items(), 1):
        text += f",\nline{i} AS (SELECT *, {e} AS {c} FROM {last})"
        last = f"line{i}"
    over = f"lag({{name}}, {{k}}) OVER (PARTITION BY {key} ORDER BY t)"
    text += f",\nproducts AS (SELECT *, {', '.join(f'{lagged(c, lags, over)} AS {c * 2}' for c in 'uv')} FROM {last}),\nsums AS (SELECT {key}, {', '.join(f'{e} AS {c}' for c, e in _OUT.items())} FROM products GROUP BY {key})"
    ratio = {c: f"(abs({c}_change) / nullif(sqrt({c}_var), 0e0))" for c in ("level", "slope")}
    tails = ", ".join(f"sqrt({c}_var) AS {c}_change_se, {ratio[c]} AS {c}_z" for c in ratio)
    text += f",\nerrors AS (SELECT *, {tails} FROM sums WHERE n_months >= {least} AND level_change IS NOT NULL)"
    ends = ", ".join(f"{two_sided(f'{c}_z')} AS {c}_change_p" for c in ratio)
    return text + f",\ntailed AS (SELECT *, {ends} FROM errors),\nfitted AS (SELECT {key}, {', '.join(f'{rounded(n, digits)} AS {n}' for n in NAMES[:-1])}, n_months::BIGINT AS n_months FROM tailed)"
