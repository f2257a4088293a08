import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from reflume.llm import tokencount as tc
from reflume.llm.queries import tokenizer

from .cases import LONG, documents, none

PIECES = ["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bb", "abb", "éa"]


def brute(scores, byte, word):
    """Best score, token count and pieces over every segmentation, by the prefixes one after another."""
    best = [(0.0, 0, ())]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + size * byte, best[end - 1][1] + size, best[end - 1][2])]
        options += [(best[a][0] + scores[word[a:end]], best[a][1] + 1, (*best[a][2], word[a:end])) for a in range(max(0, end - 16), end) if word[a:end] in scores]
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1]


def test_tries_equal_recursion(monkeypatch):
    rng = random.Random(2)
    pieces, scores = tc.Pieces(PIECES), np.log(np.random.default_rng(3).dirichlet(np.ones(len(PIECES))))
    of, byte = dict(zip(PIECES, scores.tolist(), strict=True)), scores.min() - tc.UNKNOWN
    words = sorted({tc.START + "".join(rng.choice("abéz") for _ in range(rng.randint(0, 12))) for _ in range(400)} | {tc.START + "ab" * 300})
    wanted = [brute(of, byte, w) for w in words]
    weights = np.array([rng.randint(1, 9) for _ in words])
    for at_once in (1 << 18, 40):
        monkeypatch.setattr(tc, "AT_ONCE", at_once)
        tokens, totals = tc.word_scores(words, pieces, scores)
        assert tokens.tolist() == [n for _, n, _ in wanted] and np.allclose(totals, [s for s, _, _ in wanted], atol=1e-9)
    trie = tc.Trie(words, pieces)
    trie.forward(scores)
    used = Counter()
    for (_, _, parts), n in zip(wanted, weights.tolist(), strict=True):
        for p in parts:
            used[p] += n
    assert trie.usage(weights).tolist() == [used[p] for p in PIECES]


def test_prefixes_are_shared():
    trie = tc.Trie(["▁abab", "▁abba", "▁ab", "▁b"], tc.Pieces(PIECES))
    assert len(trie.ways) - 1 == 8 and trie.levels.tolist() == [1, 2, 4, 5, 7, 9]


def test_the_query_equals_a_loop(spark):
    """Hard EM and counts over all rows, word by word."""
    rng = random.Random(5)
    rows = [(n, " ".join("".join(rng.choice("etaoin é") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 40)))) for n in range(60)]
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, rows[5][1]), (63, rows[5][1]), (64, "x" * 3000), (None, "語 the end")]
    path = tokenizer("piece_bpe_32k.model")
    names = tc.vocabulary(path).names
    uses = Counter()
    for _ in range(tc.ROUNDS + 1):
        total = sum(uses.values()) + tc.SMOOTH * len(names)
        scores = {p: math.log((uses[p] + tc.SMOOTH) / total) for p in names}
        byte = min(scores.values()) - tc.UNKNOWN
        model = {w: brute(scores, byte, tc.START + w) for w in {w for _, t in rows for w in (t or "").split()}}
        uses = Counter(p for _, t in rows for w in (t or "").split() for p in model[w][2])
    wanted = [(i, len((t or "").split()), sum(model[w][1] for w in (t or "").split()), round(sum(model[w][0] for w in (t or "").split()), 6)) for i, t in rows]
    found = [(r.doc_id, r.n_words, r.n_tokens, round(r.score, 6)) for r in tc.counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


def test_slices_and_forgetting_change_nothing(spark, monkeypatch):
    texts = pa.array([LONG, None, "a b", "", "c" * 100])
    monkeypatch.setattr(tc, "TEXT_AT_ONCE", 50)
    assert pa.concat_arrays(list(tc.sliced(texts))).equals(texts)


def test_odd_rows(spark):
    docs = documents(spark)
    path = tokenizer("piece_bpe_32k.model")
    found = tc.counts(docs, path).collect()
    assert len(found) == docs.count() and tc.counts(none(spark), path).count() == 0
    assert {r.n_tokens for r in found if r.doc_id in (3, 4, 5)} == {0} and all(r.n_tokens >= r.n_words for r in found)
