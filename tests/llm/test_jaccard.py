import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reflume.llm import jaccard

from .cases import documents, none


def sets(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent):
    of = [sets(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if of[i] and of[j] and 100 * len(of[i] & of[j]) >= percent * len(of[i] | of[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return sorted(((i, len(of[n]), least.get(find(n))) for n, (i, _) in enumerate(rows)), key=repr)


def copies(seed, families=12, size=14):
    """Families of texts that differ from their base by anything from a word to half of it, and a passage that most of them hold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    common = [rng.choice(words) for _ in range(20)]
    rows = []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 6, 9, 17, 40, 90, 260]))]
        if rng.random() < 0.6:
            base += common
        for _ in range(size):
            own = list(base)
            for _ in range(int(len(own) * rng.choice([0, 0.01, 0.02, 0.03, 0.05, 0.2]) + rng.random())):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.3:
                own = own[: max(1, int(len(own) * rng.uniform(0.8, 1)))]
            rows.append((len(rows) + 3, " ".join(own)))
    return rows


@pytest.mark.parametrize(("k", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (1, 50, 3)])
def test_components_equal_brute_force(spark, k, percent, seed):
    rows = copies(seed)
    found = jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k, percent).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows, k, percent)


def test_linked_sets_share_a_key_and_pass_both_sketches():
    rng = np.random.default_rng(6)
    for percent in (50, 80, 85, 95):
        for size in (1, 2, 5, 7, 8, 15, 16, 31, 40, 130, 900):
            for _ in range(6):
                a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
                drop, add = rng.integers(0, len(a) // 3 + 1), rng.integers(0, len(a) // 3 + 1)
                b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**64, add, dtype=np.uint64)]))
                shared = len(np.intersect1d(a, b))
                if len(b) and 100 * shared >= percent * (len(a) + len(b) - shared):
                    (mine, spare), (others, too) = jaccard.segment_keys(a, percent), jaccard.segment_keys(b, percent)
                    both = np.bincount(np.intersect1d(mine, others) % 4, minlength=4)
                    assert any(n > max(s, t) for n, s, t in zip(both, spare, too, strict=True))
                    most = (100 - percent) * (len(a) + len(b)) / (100 + percent)
                    assert jaccard.least_apart(jaccard.wide_parity(a), jaccard.wide_parity(b)) <= most
                    assert int(np.bitwise_count((jaccard.parity(a) ^ jaccard.parity(b)).view(np.uint64)).sum()) <= most


def test_small_linked_sets_keep_a_shared_key():
    rng = np.random.default_rng(11)
    for _ in range(60_000):
        percent, size = int(rng.choice([30, 50, 80, 85])), int(rng.integers(1, 31))
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.integers(0, max(1, len(a) // 4)) :], rng.integers(0, 2**64, rng.integers(0, max(2, len(a) // 2)), dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= percent * (len(a) + len(b) - shared):
            (mine, spare), (others, too) = jaccard.segment_keys(a, percent), jaccard.segment_keys(b, percent)
            both = np.bincount(np.intersect1d(mine, others) % 4, minlength=4)
            assert any(n > max(s, t) for n, s, t in zip(both, spare, too, strict=True))


def test_every_pair_of_sizes_that_may_link_has_a_band():
    for percent in (30, 50, 80, 85, 100):
        for size in (*range(1, 300), 1000, 4097):
            mine = jaccard.bands(size, percent)
            assert len(mine) <= 2 and len({band % 4 for band, _, _ in mine}) == len(mine)
            for other in range(size, min(100 * size // percent, size + 400) + 1):
                band = set(mine) & set(jaccard.bands(other, percent))
                assert any(apart >= jaccard.most_apart(size + other, percent) for _, apart, _ in band)


def test_stars_equal_union_find(spark):
    rng = random.Random(7)
    links = spark.createDataFrame([(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(190)] + [(i, i + 1) for i in range(1000, 1040)], "a long, b long").where("a != b")
    one = sorted(map(tuple, jaccard.components(links).collect()))
    assert one == sorted(map(tuple, jaccard.components(links, one_task=0).collect()))


def test_odd_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, jaccard.link_components(docs).collect()), key=repr) == brute(rows, 5, 80)
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr) == sorted([None, -9, 0, 3, 4, 5, 6, 7, 8, 10], key=repr)
    assert jaccard.link_components(none(spark)).count() == 0 and jaccard.representatives(none(spark)).count() == 0
    assert docs.where(F.col("doc_id") == 0).count() == 1


def test_long_texts_that_share_passages(spark, monkeypatch):
    """Families with shared passages between the threshold and far below it, whose keys stay unfinished."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    said = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [said(n) for n in (60, 60, 300, 900)]
    rows = []
    for n in range(90):
        body = [said(rng.choice([20, 150, 400])), *rng.sample(passages, rng.choice([1, 2, 3]))]
        rng.shuffle(body)
        text = [w for part in body for w in part]
        rows.append((n, " ".join(text)))
        if n % 9 == 0:
            for k in (4, 40, 160):
                own = list(text)
                for _ in range(len(own) // k):
                    own[rng.randrange(len(own))] = rng.choice(words)
                rows.append((1000 + 10 * n + k % 7, " ".join(own)))
    monkeypatch.setattr(jaccard, "BEFORE", 2)
    for k, percent in ((5, 80), (2, 60)):
        found = jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, percent).collect()
        assert sorted(map(tuple, found), key=repr) == brute(rows, k, percent)


def test_rows_of_one_id_go_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c.upper()), (9, "Z " + b), (None, a), (11, None), (11, ""), (11, "")]
    docs = spark.createDataFrame([(i, t, n, str(n), n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, _maybe int, _gone string, _key long")
    kept = jaccard.representatives(docs).collect()
    assert all((r.doc_id, r.text) == rows[r._key] and r._maybe == r._key and r._gone == str(r._key) for r in kept)
    texts = sorted(((r.doc_id, r.text.lower() if r.text else r.text) for r in kept), key=repr)
    assert texts == sorted([(1, a), (5, b), (7, c), (None, a), (11, None), (11, ""), (11, "")], key=repr)  # rows without words all stay
