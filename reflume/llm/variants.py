"""Grouping of spelling variants: words that differ by one inserted, deleted or replaced character, by forward and backward automata.

One error lies in a word's first half or in its second. So every word is looked up twice: by its first half, exactly, and then
one error in what follows, in a minimal acyclic automaton of the words; and likewise by its second half in an
automaton of the words backward. Words are dealt to tasks by the halves that a word within one error may have in common with
them, so that a task's automata hold only the words of its halves, some at a time. An automaton is made of the sorted words' trie, whose nodes
with the same words below them are one state, by height; its edges count the words before them, which gives each word that is
reached its number in the sorted list, without a table of words at the states. All look-ups of a block go through the automaton side by side, in arrays. A word
that both directions find counts in the forward one only.

A half that more than GROUP words have is split: its words are dealt to parts, and each of its look-ups is made in all of them.

Of a word's near words the most frequent, ties to the smallest in code-point order, is its form where it is at least TIMES as frequent. Counts
at least double along forms, so chains have no cycles and are short; roots are found by doubling the steps in joins.

Null texts have no words; a null doc_id is spelled as nothing; repeated rows count each. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import code_points, ragged
from .common import bounded_batches, drop_stage, materialize, mix64, shuffle_partitions

#: Words have so many characters and occurrences; a form has so many times the occurrences; one in DAMAGED runs loses a character.
SHORTEST, RAREST, TIMES, DAMAGED = 5, 3, 2, 97
#: Distinct words that a task counts before it passes them on, words of an automaton, words of a half that isn't split.
COUNTED, BLOCK, GROUP = 1 << 18, 1 << 15, 1 << 16
#: Latin-1 bytes of runs: A-Z in lower case, letters and U+00C0 to U+00FF as they are, the rest blank.
_RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def counts(docs: DataFrame, damaged: int = DAMAGED, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """word and n of the runs of letters of all texts, of which one in ``damaged`` loses a character by the crc32 of ``doc_id:run``; 0 leaves them as they are."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = value.as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # what isn't Latin-1 becomes a question mark, which ends a run as well
                for word, n in Counter(text.encode("latin-1", "replace").translate(_RUNS).split()).items():
                    size = len(word)
                    if size < shortest:
                        continue
                    if damaged:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        if h % damaged == 0:
                            word = word[: h % size] + word[h % size + 1 :]
                            if size == shortest:
                                continue
                    found[word] = found.get(word, 0) + n
                if len(found) >= COUNTED:
                    yield passed()
        yield passed()

    each = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


class Automaton:
    """The minimal acyclic automaton of sorted, distinct words, with the number of each word."""

    def __init__(self, words: list[str]):
        sizes = np.array([len(w) for w in words], np.int64)
        points = code_points("".join(words))
        self.letters, codes = np.unique(points, return_inverse=True)
        count, wide = len(words), int(sizes.max(initial=0))
        table = np.full((count, wide + 1), -1, np.int64)
        table[np.repeat(np.arange(count), sizes), ragged(np.zeros(count, np.int64), sizes)] = codes
        # a node for each distinct prefix: word i has new ones beyond what it shares with the word before
        shared = np.zeros(count, np.int64)
        shared[1:] = np.argmin(np.concatenate([table[1:] == table[:-1], np.zeros((count - 1, 1), bool)], axis=1), axis=1)
        fresh = sizes - shared
        nodes = int(fresh.sum()) + 1
        depth = np.concatenate([[0], shared.repeat(fresh) + 1 + ragged(np.zeros(count, np.int64), fresh)])
        word = np.concatenate([[0], np.repeat(np.arange(count), fresh)])
        at = np.zeros((count, wide + 1), np.int64)  # the node of each prefix
        at[word[1:], depth[1:]] = np.arange(1, nodes)
        np.maximum.accumulate(at, axis=0, out=at)
        inside = np.arange(wide + 1) <= sizes[:, None]
        below = np.bincount(at[inside], minlength=nodes)
        height = np.zeros(nodes, np.int64)
        np.maximum.at(height, at[inside], (sizes[:, None] - np.arange(wide + 1))[inside])
        parent = at[word[1:], depth[1:] - 1]
        letter = table[word[1:], depth[1:] - 1]
        final = np.zeros(nodes, bool)
        final[at[np.arange(count), sizes]] = True
        # nodes of a height are one state where the words below them are the same: the same edges to the same states
        state, seen, made = np.zeros(nodes, np.int64), final.astype(np.uint64), 0
        order = np.argsort(height, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(height))])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = order[a:b]
            kinds, which = np.unique(seen[own], return_inverse=True)
            state[own] = made + which
            made += len(kinds)
            own = own[own > 0]
            with np.errstate(over="ignore"):
                np.add.at(seen, parent[own - 1], mix64(mix64(state[own].astype(np.uint64) + np.uint64(1)) + letter[own - 1].astype(np.uint64)))
        first = np.full(made, nodes, np.int64)
        np.minimum.at(first, state, np.arange(nodes))
        kept = np.flatnonzero(first[state[parent]] == parent)  # edges of each state's first node
        self.size = len(self.letters) + 1
        keys = state[parent[kept]] * self.size + letter[kept]
        order = np.argsort(keys)
        self.keys, child = keys[order], kept[order] + 1
        self.to = state[child]
        self.begins = np.searchsorted(self.keys, np.arange(made + 1) * self.size)
        self.final = final[first]
        words_of = below[child]
        upto = np.concatenate([[0], np.cumsum(words_of)])
        of = self.keys // self.size
        self.before = upto[:-1] - upto[self.begins[of]] + self.final[of]
        self.start, self.states = int(state[0]), made

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of letter numbers for each word, and sizes; letters that the automaton lacks have a number of their own."""
        sizes = np.array([len(w) for w in words], np.int64)
        points = code_points("".join(words))
        spot = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        table = np.full((len(words), int(sizes.max(initial=0)) + 1), self.size - 1, np.int64)
        table[np.repeat(np.arange(len(words)), sizes), ragged(np.zeros(len(words), np.int64), sizes)] = np.where(self.letters[spot] == points, spot, self.size - 1)
        return table, sizes

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the items can go on by their letter, and the edges of those."""
        keys = state * self.size + letter
        edge = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = np.flatnonzero(self.keys[edge] == keys)
        return there, edge[there]

    def one_error(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a place in words and the number of a word of the automaton that has its first ``exact`` characters and one error after them."""
        table, sizes = self.coded(words)
        item, state, number = np.arange(len(words)), np.full(len(words), self.start), np.zeros(len(words), np.int64)
        for at in range(int(exact.max(initial=0))):
            going = at < exact[item]
            there, edge = self.step(state[going], table[item[going], at])
            still = ~going
            live = np.flatnonzero(going)[there]
            item, number, state = (np.concatenate([x[still], y]) for x, y in ((item, item[live]), (number, number[live] + self.before[edge]), (state, self.to[edge])))
        place = exact[item]
        wrong: list[tuple[np.ndarray, ...]] = []
        while len(item):
            inner = place < sizes[item]
            wrong.append((item[inner], state[inner], number[inner], place[inner] + 1))  # the word has one more
            few = self.begins[state + 1] - self.begins[state]
            edge, of = ragged(self.begins[state], few), np.repeat(np.arange(len(item)), few)
            wrong.append((item[of], self.to[edge], number[of] + self.before[edge], place[of]))  # the word lacks one
            other = inner[of] & (self.keys[edge] % self.size != table[item[of], place[of]])
            edge, of = edge[other], of[other]
            wrong.append((item[of], self.to[edge], number[of] + self.before[edge], place[of] + 1))  # another one
            live = np.flatnonzero(inner)
            there, edge = self.step(state[live], table[item[live], place[live]])
            live = live[there]
            item, state, number, place = item[live], self.to[edge], number[live] + self.before[edge], place[live] + 1
        item, state, number, place = (np.concatenate(x) for x in zip(*wrong, strict=True)) if wrong else (np.empty(0, np.int64),) * 4
        pairs = []
        while len(item):
            ended = place == sizes[item]
            met = ended & self.final[state]
            pairs.append((item[met], number[met]))
            live = np.flatnonzero(~ended)
            there, edge = self.step(state[live], table[item[live], place[live]])
            live = live[there]
            item, state, number, place = item[live], self.to[edge], number[live] + self.before[edge], place[live] + 1
        item, number = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 2
        both = np.unique(item << 32 | number)  # a word that several errors lead to
        return both >> 32, both & 0xFFFFFFFF


def looked_up(words: list[str], n: list[int], backward: list[bool], exact: list[int], entry: list[bool], asked: list[bool]) -> list[tuple]:
    """word, n, near, best_n and best of each word that is asked for, among the entries of the same direction. Words of the backward direction are reversed."""
    out = []
    for way in sorted(set(backward)):
        counted = {w: c for w, c, b, e in zip(words, n, backward, entry, strict=True) if b == way and e}
        queries = [i for i, (b, q) in enumerate(zip(backward, asked, strict=True)) if b == way and q]
        given = [words[i] for i in queries]
        if not given:
            continue
        item, number = np.empty(0, np.int64), np.empty(0, np.int64)
        if counted:
            entries = sorted(counted)
            item, number = Automaton(entries).one_error(given, np.array([exact[i] for i in queries], np.int64))
            if way:  # what begins alike, as far as the forward look-up is exact, was found by that
                ends = [w[len(w) - len(w) // 2 :] for w in given]
                late = np.array([not entries[m].endswith(ends[q]) for q, m in zip(item.tolist(), number.tolist(), strict=True)], bool)
                item, number = item[late], number[late]
        near = np.bincount(item, minlength=len(given)).tolist()
        best: dict[int, tuple[int, str]] = {}
        if len(item):
            often = np.array([counted[w] for w in entries], np.int64)[number]
            most = np.zeros(len(given), np.int64)
            np.maximum.at(most, item, often)
            for q, m, c in zip(*(x[often == most[item]].tolist() for x in (item, number, often)), strict=True):
                word = entries[m][::-1] if way else entries[m]
                if q not in best or word < best[q][1]:
                    best[q] = (c, word)
        out += [(w[::-1] if way else w, n[i], near[q], *best.get(q, (None, None))) for q, (i, w) in enumerate(zip(queries, given, strict=True))]
    return out


def near(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, n, n_near (words that are one error away), best_n and best (the most frequent of them, ties to the smallest) of words (word, n)."""
    size, whole = F.length("word"), F.reverse("word")
    low = F.floor(size / 2).cast("int")
    up = F.ceil(size / 2).cast("int")

    def side(backward: bool, exact, asked):
        return F.struct(F.lit(backward).alias("backward"), (whole if backward else F.col("word")).alias("word"), exact.cast("int").alias("exact"), asked.alias("asked"))

    # the halves of all words within one error: a word of size m asks by its m // 2 first or its other last characters
    sides = F.array(side(False, up - 1, low == up - 1), side(False, up, low == up), side(True, low, up == low), side(True, low + 1, up == low + 1))
    rows = words.select("n", F.explode(sides).alias("s")).select("s.*", "n").withColumn("half", F.expr("left(word, exact)"))
    rows = rows.withColumns({"part": F.lit(-1), "entry": F.lit(True)})
    hot = rows.groupBy("backward", "half", "exact").agg(F.count("*").alias("many")).where(F.col("many") > group)
    if not hot.isEmpty():
        parts = hot.select("backward", "half", "exact", F.ceil(F.col("many") / group).cast("int").alias("parts"))
        rows = rows.join(parts, ["backward", "half", "exact"], "left")
        own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
        others = F.when(F.col("parts").isNull(), F.array(F.lit(-1))).when(F.col("asked"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
        rows = rows.withColumn("own", own).withColumn("part", F.explode(others)).withColumn("entry", F.coalesce(F.col("part") == F.col("own"), F.lit(True)))
    columns = ["backward", "half", "part", "word", "n", "exact", "entry", "asked"]
    dealt = rows.select(*columns).repartition(shuffle_partitions(words.sparkSession), "backward", "half", "part").sortWithinPartitions("backward", "half", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, ...]] = []  # blocks of whole halves

        def made(blocks: list[tuple[list, ...]]) -> pa.RecordBatch:
            backward, _, _, word, n, exact, entry, asked = ([x for b in blocks for x in b[c]] for c in range(8))
            found = list(zip(*looked_up(word, n, backward, exact, entry, asked), strict=True)) or [[]] * 5
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types, strict=True)], names=["word", "n", "near", "best_n", "best"])

        last = None
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in columns]
            keys = list(zip(*rows[:3], strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                # a part of a split half has a block of its own, as its words may lie in other parts by other halves
                if keys[a] != last and held and (sum(len(x[0]) for x in held) >= BLOCK or keys[a][2] >= 0 or last[2] >= 0):
                    yield made(held)
                    held = []
                last = keys[a]
                held.append(tuple(c[a:b] for c in rows))
        if held:
            yield made(held)

    each = dealt.mapInArrow(run, "word string, n long, near long, best_n long, best string")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    return each.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of each word that has a form (word, form): the last of its forms, by steps that double."""
    found = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        after = found.join(onward, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved"))
        after = materialize(after, "roots")
        drop_stage(found)
        found = after.drop("moved")
        if after.where("moved").isEmpty():
            return found


def grouped(words: DataFrame, times: int = TIMES, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near and form_n of words (word, n)."""
    frequent = F.col("best_n") >= times * F.col("n")
    found = near(words, group).select("word", "n", "n_near", F.when(frequent, F.col("best")).alias("form"), F.when(frequent, F.col("best_n")).alias("form_n"))
    found = materialize(found, "forms")
    ends = roots(found.where("form is not null").select("word", "form")).select(F.col("word").alias("_word"), "root")
    return found.join(ends, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, damaged: int = DAMAGED, shortest: int = SHORTEST, rarest: int = RAREST, times: int = TIMES) -> DataFrame:
    """The words of all texts with their forms and roots."""
    return grouped(materialize(counts(docs, damaged, shortest, rarest), "words"), times)
