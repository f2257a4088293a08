import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from reflume.llm import variants
from reflume.llm.queries import op13_spelling_variants

from .cases import documents, none

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(docs):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def brute(words):
    """The rows of words and counts, by all pairs of like sizes."""
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def some_words(seed, count, letters="abcé", sizes=(5, 9)):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))): rng.choice([3, 4, 6, 8, 12, 24, 100]) for _ in range(count)}


def test_automaton_is_minimal_and_numbers_its_words():
    words = sorted(some_words(1, 800))
    made = variants.Automaton(words)
    ends = {w: frozenset(v[len(w) :] for v in words if v.startswith(w)) for v in words for n in range(len(v) + 1) for w in [v[:n]]}
    assert made.states == len(set(ends.values()))
    table, sizes = made.coded(words)
    state, number = np.full(len(words), made.start), np.zeros(len(words), np.int64)
    for at in range(int(sizes.max())):
        going = np.flatnonzero(at < sizes)
        there, edge = made.step(state[going], table[going, at])
        assert len(there) == len(going)
        state[going], number[going] = made.to[edge], number[going] + made.before[edge]
    assert number.tolist() == list(range(len(words))) and made.final[state].all()


@pytest.mark.parametrize("exact", [0, 2])
def test_one_error_equals_all_pairs(exact):
    words = sorted(some_words(2, 500))
    asked = [*words[::3], "zzzzz", "abcabX", "a" * 12]
    item, number = variants.Automaton(words).one_error(asked, np.full(len(asked), exact))
    found = {(asked[i], words[m]) for i, m in zip(item.tolist(), number.tolist(), strict=True)}
    assert found == {(a, b) for a in asked for b in words if a[:exact] == b[:exact] and one_apart(a[exact:], b[exact:])}


@pytest.mark.parametrize(("group", "block"), [(variants.GROUP, variants.BLOCK), (7, variants.BLOCK), (variants.GROUP, 20), (3, 10)])
def test_groups_equal_all_pairs_split_or_not(spark, monkeypatch, group, block):
    monkeypatch.setattr(variants, "BLOCK", block)
    words = some_words(3, 900) | {"aaaaa" + "b" * n: 3 * 2**n for n in range(9)}
    rows = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    found = variants.grouped(rows, group=group)
    assert found.columns == COLUMNS
    got = found.collect()
    assert len(got) == len(words) and {tuple(r) for r in got} == brute(words)


def test_any_letters(spark):
    words = some_words(5, 300, "日本語é🙂") | {"aaaaaaa": 9}
    assert {tuple(r) for r in variants.grouped(spark.createDataFrame(list(words.items()), "word string, n long")).collect()} == brute(words)


def test_chains_end_at_the_last_form(spark):
    forms = [(f"w{n}", f"w{n + 1}") for n in range(37)] + [(f"s{n}", "w3") for n in range(50)]
    found = {r.word: r.root for r in variants.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert set(found.values()) == {"w37"} and len(found) == 87


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    pool = [*some_words(7, 120), "Straße", "ÉCLAIR", "éclair", "naïve", "naive", "x×y÷z", "don't", "a1b2c3", "Ωmega", "one", "Word", "words", "sword"]
    rows = [(n if n % 9 else None, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 300)))) for n in range(60)]
    rows += [(5, None), (6, ""), (7, "éclairs " * 40_000), (7, "éclairs " * 3), (7, "éclairs " * 3)]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    docs.unionByName(documents(spark), allowMissingColumns=True).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    given = [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()]
    found = op13_spelling_variants(spark, str(tmp_path))
    assert found.columns == COLUMNS
    got = found.collect()
    want = brute(brute_counts(given))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert variants.variants(none(spark)).count() == 0


def test_passing_words_on_changes_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_counts((r.doc_id, r.text) for r in docs.collect())
    assert {r.word: r.n for r in variants.counts(docs).collect()} == want
    monkeypatch.setattr(variants, "COUNTED", 10)
    assert {r.word: r.n for r in variants.counts(docs).collect()} == want
