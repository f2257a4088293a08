"""The queries without SQL, against NumPy and loops over the same tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from reflume.operators import estimates, logits, resolve
from reflume.plans import estimates as plans
from reflume.plans.identifiers import WORDS
from reflume.plans.queries import ORACLES, QUERIES
from reflume.sources.standins import SQL

DATA = "/root/testdata/sf0.001"
NAMES = ["level_change", "level_change_se", "level_change_p", "slope_change", "slope_change_se", "slope_change_p", "pre_mean_rate", "n_months"]


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for name in os.listdir(DATA):
        made.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return made


def months(duck):
    return [r[0] for r in duck.execute("SELECT strftime(m, '%Y-%m') FROM range(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH) r(m)").fetchall()]


def rates(duck, where="true"):
    found = dict(duck.execute(SQL + f"SELECT month, round(sum(late)::DOUBLE / nullif(sum(n_refs), 0) * 10000, 6) FROM counted WHERE {where} GROUP BY 1").fetchall())
    return [found.get(m) for m in months(duck)]


def fit(points, break_at):
    """OLS by least squares and the HAC meat by its double sum over pairs of months."""
    rows = [(t, y) for t, y in points if y is not None]
    x = np.array([[1.0, t, float(t >= break_at), (t - break_at) * float(t >= break_at)] for t, _ in rows])
    y = np.array([v for _, v in rows])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    u = x * (y - x @ beta)[:, None]
    meat = sum(max(0.0, 1 - abs(i - j) / 7) * np.outer(u[i], u[j]) for i in range(len(u)) for j in range(max(0, i - 6), min(len(u), i + 7)))
    inverse = np.linalg.inv(x.T @ x)
    se = np.sqrt(np.diag(inverse @ meat @ inverse))
    p = [math.erfc(abs(b / e) / math.sqrt(2)) for b, e in zip(beta, se, strict=True)]
    before = [v for t, v in rows if t < break_at]
    return [beta[2], se[2], p[2], beta[3], se[3], p[3], sum(before) / len(before), len(rows)]


def test_its_fit_and_its_truncations(spark, duck):
    y = list(enumerate(rates(duck)))
    found = QUERIES["its_fit"](spark, DATA).collect()
    assert len(found) == 1 and np.allclose([found[0][n] for n in NAMES], fit(y, plans.BREAK), rtol=1e-6, atol=1e-9)
    cut = {r["end"]: r for r in QUERIES["its_truncation"](spark, DATA).collect()}
    assert sorted(cut) == [72, 74, 76, 78]
    for end, r in cut.items():
        assert np.allclose([r[n] for n in NAMES], fit(y[: end + 1], plans.BREAK), rtol=1e-6, atol=1e-9)


def test_its_placebos(spark, duck):
    y = list(enumerate(rates(duck)))[: plans.BREAK]
    found = {r.break_at: r.level_change for r in QUERIES["its_placebo"](spark, DATA).collect()}
    assert sorted(found) == list(range(6, plans.BREAK - 5))
    assert all(abs(found[k] - fit(y, k)[0]) < 1e-6 for k in found)


def test_its_by_field(spark, duck):
    found = {r.field: r for r in QUERIES["its_by_field"](spark, DATA).collect()}
    at = {m: t for t, m in enumerate(months(duck))}
    for field in [r[0] for r in duck.execute(SQL + "SELECT field FROM counted GROUP BY 1 ORDER BY sum(late) DESC, field LIMIT 8").fetchall()]:
        rows = duck.execute(SQL + "SELECT month, round(sum(late)::DOUBLE / nullif(sum(n_refs), 0) * 10000, 6) FROM counted WHERE field = ? GROUP BY 1 ORDER BY 1", [field]).fetchall()
        points = [(at[m], v) for m, v in rows if m in at]
        if sum(v is not None for _, v in points) >= 24:
            # months that a field lacks leave its fit, but lags count the months that are there
            assert np.allclose([found[field][n] for n in ("level_change", "slope_change", "n_months")], [fit(points, plans.BREAK)[k] for k in (0, 3, 7)], rtol=1e-6)
        else:
            assert field not in found


def test_bootstrap_query(spark, duck):
    rows = duck.execute(f"WITH x AS ({ORACLES['papers_to_check']}) " + 'SELECT x."group", o.late, o.n_refs FROM x JOIN (' + SQL + "SELECT id, late, n_refs FROM counted WHERE n_refs > 0) o USING (id)").fetchall()
    groups = {g: np.array([r[1:] for r in rows if r[0] == g], float) for g in ("artifact", "control")}
    rate = {g: v[:, 0].sum() / v[:, 1].sum() * 1000 for g, v in groups.items()}
    found = QUERIES["bootstrap_ci"](spark, DATA).first()
    assert (found.n_artifact, found.n_control) == tuple(len(v) for v in groups.values())
    assert abs(found.rate_artifact - rate["artifact"]) < 1e-9 and abs(found.rate_control - rate["control"]) < 1e-9
    rng = np.random.default_rng(1)
    drawn = {g: (lambda s: s[:, :, 0].sum(1) / s[:, :, 1].sum(1))(v[rng.integers(0, len(v), (4000, len(v)))]) for g, v in groups.items()}
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = drawn["artifact"] / drawn["control"]
    lo, hi = np.nanpercentile(ratio[np.isfinite(ratio)], [2.5, 97.5])
    if rate["control"]:
        assert abs(found.ratio - rate["artifact"] / rate["control"]) < 1e-9 and abs(found.ratio_lo - lo) <= 0.15 * max(lo, 0.2) and abs(found.ratio_hi - hi) <= 0.15 * hi


def test_bootstrap_in_buckets(spark):
    rng = np.random.default_rng(2)
    rows = [(g, int(rng.poisson(k)), int(n)) for g, k in (("artifact", 6), ("control", 3)) for n in rng.integers(50, 5000, 400)]
    table = spark.createDataFrame(rows, "group string, events int, of int")
    one, many = (estimates.bootstrap_ratio(table, 1500, at_once=n).first() for n in (50_000, 60))
    assert one.ratio == many.ratio and (one.n_artifact, one.n_control) == (many.n_artifact, many.n_control) == (400, 400)
    assert abs(one.ratio_lo - many.ratio_lo) < 0.05 and abs(one.ratio_hi - many.ratio_hi) < 0.05 and one.ratio_lo < one.ratio < one.ratio_hi


def logit(rows):
    """Newton's method for y on proxy and log references."""
    x = np.array([[1.0, float(s), math.log(n)] for s, _, n in rows])
    y = np.array([float(e > 0) for _, e, _ in rows])
    beta = np.zeros(3)
    for _ in range(60):
        mean = 1 / (1 + np.exp(-x @ beta))
        hessian = (x * (mean * (1 - mean))[:, None]).T @ x
        beta += np.linalg.solve(hessian, x.T @ (y - mean))
    return math.exp(beta[1]), math.sqrt(np.linalg.inv(hessian)[1, 1])


def close(found, rows):
    ratio, se = logit(rows)
    return found.n == len(rows) and abs(found.odds_ratio / ratio - 1) < 1e-4 and abs(found.or_hi / (ratio * math.exp(1.96 * se)) - 1) < 1e-3


def test_logit_query(spark, duck):
    rows = duck.execute(SQL + "SELECT proxy, events, n_refs FROM scored WHERE n_refs > 0").fetchall()
    found = QUERIES["logit_adjusted"](spark, DATA).collect()
    if len(rows) >= 100 and len({r[0] for r in rows}) == 2:
        assert len(found) == 1 and close(found[0], rows)
    else:
        assert found == []


def test_logit_on_counts_equals_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(1, bool(s), int(rng.random() < 0.2 + 0.3 * s), int(n)) for s, n in zip(rng.integers(0, 2, 600), rng.integers(1, 30, 600), strict=True)]
    table = spark.createDataFrame(rows, "k int, proxy boolean, events int, n_refs int")
    counted = table.groupBy("k", "proxy", "events", "n_refs").count().withColumnRenamed("count", "w")
    whole, few = (logits.fits(logits.kinds(t, ["k"]), ["k"]).first() for t in (table, counted))
    assert close(whole, [r[1:] for r in rows]) and close(few, [r[1:] for r in rows])


def test_threshold_sweep(spark, duck):
    rows = duck.execute(f"SELECT score, quality, floor(n_chars / 50)::BIGINT FROM ({ORACLES['lexical_score']}) JOIN labels USING (doc_id) JOIN documents USING (doc_id)").fetchall()
    found = {(r.markers, r.min_refs): r for r in QUERIES["threshold_sweep"](spark, DATA).collect()}
    wanted = 0
    for markers in (3, 4, 5):
        for least in (10, 20, 30, 40):
            own = [(s >= markers, e, n) for s, e, n in rows if n > 0 and n >= least]
            if len(own) >= 100 and len({r[0] for r in own}) == 2 and len({r[1] > 0 for r in own}) == 2:
                wanted += 1
                assert found[markers, least].n == len(own)
                if min(sum(r[0] for r in own), sum(not r[0] for r in own)) > 10:
                    assert close(found[markers, least], own)
    assert len(found) == wanted and len(WORDS) >= 5


def test_fuzzy_titles(spark):
    known = [(n, t) for n, t in enumerate(["deep learning of crop yield", "deep learning of soil moisture", "a study of wheat", "of the", "wheat yield under drought stress"])]
    asked = [(10, "Crop yield of deep learning"), (11, "a study of wheaty"), (12, "quantum chess"), (13, "of the"), (14, None), (15, "drought stress under wheat yield")]
    found = {r.ref_id: (r.known_id, r.score) for r in resolve.fuzzy_match(spark.createDataFrame(asked, "ref_id int, title string"), spark.createDataFrame(known, "known_id int, title string")).collect()}
    for n, title in asked:
        best = max(((resolve.title_score(title, t), -k) for k, t in known), default=None)
        wanted = (-best[1], best[0]) if best and best[0] >= 85 else (None, None)
        assert found[n] == wanted, title


def test_fuzzy_title_query(spark):
    rows = QUERIES["fuzzy_title"](spark, DATA).collect()
    assert rows and all(r.score == 100 and sorted(r.ref_id.lower().split()) == sorted(["r", *r.known_id.lower().split()]) for r in rows)


def test_resumable_ingest_query(spark, duck):
    found = sorted(map(tuple, QUERIES["resumable_ingest"](spark, DATA).collect()))
    assert found == sorted(duck.execute("SELECT event_type, count(*) FROM events GROUP BY 1").fetchall())


def test_ingest_stops_at_its_deadline_and_goes_on(spark, tmp_path):
    from reflume.streaming.ingest import ingest

    for n in range(4):
        spark.range(5 * n, 5 * n + 5).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.range(1).schema
    for seconds in (1, None):
        ingest(spark, schema, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"), files_at_once=1, seconds=seconds)
    assert sorted(r.id for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()) == list(range(20))


def test_bounds_cover_the_truth(spark):
    rng = np.random.default_rng(6)
    n, q, a, b = 200_000, 0.10, 0.30, 0.05
    truth = rng.random(n) < q
    event = rng.random(n) < np.where(truth, a, b)
    proxy = rng.random(n) < np.where(truth, 0.65, 0.05)
    kinds, counts = np.unique(np.column_stack([proxy, event]).astype(int), axis=0, return_counts=True)
    rows = [(bool(s), int(e), 10) for (s, e), k in zip(kinds.tolist(), counts.tolist(), strict=True) for _ in range(k // 50)]
    inputs = estimates.bound_inputs(spark.createDataFrame(rows, "proxy boolean, events int, n_refs int"), [])
    found = estimates.bounds(inputs, estimates.grid(spark, [0.45, 0.65, 0.85], [0.90, 0.95, 0.99]), []).first()
    assert found.a_lo <= a <= found.a_hi and inputs.first().p_y_s1 < a
