import numpy as np

from reflume.llm import ann
from reflume.llm.common import materialize

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(ids, x, k=5):
    x = np.array(x, float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, q in zip(ids, unit, strict=True):
        if i % ann.EVERY == 0:
            sims = unit @ q
            out[i] = [j for _, j in sorted((-round(s, 12), j) for s, j in zip(sims, ids, strict=True) if j != i)][:k]
    return out


def found(table):
    rows = {}
    for r in sorted(table.collect(), key=lambda r: (r.query_id, r.rank)):
        rows.setdefault(r.query_id, []).append(r)
    assert all([r.rank for r in g] == list(range(1, len(g) + 1)) and [r.score for r in g] == sorted((r.score for r in g), reverse=True) for g in rows.values())
    return rows


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 128)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    got = found(ann.nearest(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)))
    want = exact(list(range(1500)), x)
    assert got.keys() == want.keys()
    assert np.mean([len({r.vec_id for r in got[q]} & set(want[q])) / 5 for q in want]) >= 0.9
    a, b = x[50].astype(float), x[got[50][0].vec_id].astype(float)
    assert abs(got[50][0].score - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-12


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    same = [1.0, 2.0, 3.0]
    rows = [(i, same, 0) for i in range(40, 160)] + [(i, rng.standard_normal(3).tolist(), 0) for i in range(10)]
    odd = [(200, None, 0), (201, [0.0, 0.0, 0.0], 0), (250, [1.0, None, 2.0], 0), (300, [float("nan"), 1.0, 1.0], 0), (350, [float("inf"), 1.0, 1.0], 0), (400, [1.0, 2.0], 0), (None, same, 0), (450, [], 0)]
    table = spark.createDataFrame(rows + odd, SCHEMA)
    got = found(ann.nearest(table))
    assert got.keys() == {0, 50, 100, 150}
    assert [r.vec_id for r in got[100]] == [40, 41, 42, 43, 44] and [r.vec_id for r in got[50]] == [40, 41, 42, 43, 44]
    assert all(abs(r.score - 1) < 1e-12 for r in got[150])
    assert {r.vec_id for r in got[0]} == set(exact([i for i, _, _ in rows], [v for _, v, _ in rows])[0])
    assert ann.nearest(table.where("vec_id >= 200")).count() == 0 and ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    few = found(ann.nearest(table.where("vec_id in (50, 2, 3)")))
    assert len(few[50]) == 2


def test_joins_go_on_until_few_lists_change(spark, monkeypatch):
    monkeypatch.setattr(ann, "ENOUGH", 2.0)
    monkeypatch.setattr(ann, "BLOCK", 32)
    x = np.random.default_rng(8).standard_normal((3000, 16)).astype(np.float32)
    vectors = ann.halved(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, x array<double>"))
    vectors = materialize(vectors, "vectors")
    near = {}
    for r in ann.graph_of(vectors, 3000, 16).collect():
        near.setdefault(r.v, set()).add(r.u)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    want = np.argsort(-sims, axis=1)[:, : ann.K]
    assert np.mean([len(near[i] & set(w.tolist())) / ann.K for i, w in enumerate(want)]) >= 0.9  # ENOUGH is beyond reach
    assert ann.beam_of(50_000) == ann.BEAM and ann.beam_of(200_000) == 2 * ann.BEAM


def test_tiny_and_huge_components_keep_their_cosines(spark):
    """Rows are scaled one by one, by powers of two, whatever lies beside them in a batch."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((120, 8))
    scale = np.ones(120)
    scale[[1, 51, 60]], scale[[2, 100, 70]], scale[[3, 80]] = 1e-200, 1e200, 1e-170
    rows = [(i, (v * c).tolist()) for i, (v, c) in enumerate(zip(x, scale, strict=True))]
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)))
    want = exact(list(range(120)), x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 50, 100):
        assert [r.vec_id for r in got[q]] == want[q]
        assert all(abs(r.score - unit[q] @ unit[r.vec_id]) < 1e-12 for r in got[q])


def test_ids_with_several_vectors(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((90, 6))
    ids = [*range(80), 50, 7, 7, 7, 8, 8, 0, 0, 50, 9]
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(7, x[7].tolist())] * 3
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got.keys() == {0, 50}
    for q in (0, 50):
        best = {}
        for a, i in enumerate(ids):
            for b, j in enumerate(ids):
                if i == q and j != q:
                    best[j] = max(best.get(j, -2), unit[a] @ unit[b])
        assert [r.vec_id for r in got[q]] == sorted(best, key=lambda j: -best[j])[:5]


def test_joins_stop_at_enough_true_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 32)
    x = np.random.default_rng(11).standard_normal((2000, 12)).astype(np.float32)
    vectors = materialize(ann.halved(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, x array<double>")), "vectors")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    true = ann.farthest(vectors).collect()
    assert len(true) == ann.SAMPLE and all(r.k == ann.K and abs(np.sort(sims[r.v])[-ann.K] - r.last) < 2e-3 for r in true)
    rounds = []
    monkeypatch.setattr(ann, "joined", lambda *a, f=ann.joined: rounds.append(1) or f(*a))
    counts = {}
    for enough in (0.3, 2.0):
        monkeypatch.setattr(ann, "ENOUGH", enough)
        rounds.clear()
        got = {}
        for r in ann.graph_of(vectors, 2000, 12).collect():
            got.setdefault(r.v, set()).add(r.u)
        counts[enough] = len(rounds)
        share = np.mean([len(got[i] & set(np.argsort(-sims[i])[: ann.K].tolist())) / ann.K for i in range(2000)])
        assert share >= min(enough, 0.9) - 0.1
    assert 1 <= counts[0.3] <= counts[2.0]
