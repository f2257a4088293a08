"""Token counts under a unigram model by dynamic programming that a trie shares.

Distinct pre-tokens (what stands between Unicode's white space, each with the word-start mark before it)
are inserted in a trie. The forward score of a node, the best log probability of any
segmentation of its prefix into pieces, is computed once, from the nodes at most a piece's length above,
however many words go on from there; a word's terminal stores its token count and score. Tries are
arrays, worked out level by level. A task remembers the words that it has scored and starts anew at a fixed
number of them, which bounds its memory and changes no result.

Pieces are those of a public vocabulary file. Their probabilities are fitted to the whole
corpus by hard EM: Spark counts the distinct pre-tokens of all texts, and in each round
every one of them is segmented as the last round's model has it, its pieces are counted, and log((n + SMOOTH) /
(total + SMOOTH * pieces)) is their new score. The first round has all pieces alike. A character
that no piece covers costs its UTF-8 bytes' number of tokens, as byte pieces would, each
UNKNOWN below the least likely piece. Of equally likely segmentations the one with fewer tokens counts, then the
one whose last piece is longest.

Null, empty and blank texts have no tokens and score 0. Repeated rows count each, in the
fit too. Without words all pieces stay alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop_stage, held, materialize, mix64, powers, random_words

START = "▁"
#: Rounds of the fit, what each piece's count gets added, and what a byte costs below the least likely piece.
ROUNDS, SMOOTH, UNKNOWN = 2, 0.1, 10.0
#: Characters whose words go through one trie, characters of text handled at once, words remembered in a task.
AT_ONCE, TEXT_AT_ONCE, REMEMBERED = 1 << 18, 1 << 23, 1 << 18
_BASE = 0xD1342543DE82EF95
SUFFIX, NOTHING = -1, -2


@lru_cache(1)
def letters() -> np.ndarray:
    return random_words(41, 0x110000)


class Pieces:
    """A vocabulary's pieces and their suffixes, found by the hash of their characters."""

    def __init__(self, pieces: list[str]):
        self.names = pieces
        self.longest = max(map(len, pieces), default=1)
        sizes = np.array([len(p) for p in pieces], np.int64)
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.int32)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(points))  # characters from each place to its piece's end
        keys, ids = [], []
        for length in range(1, self.longest + 1):
            at = np.flatnonzero(left == length)
            spots = at[:, None] + np.arange(length)
            with np.errstate(over="ignore"):
                keys.append(mix64((letters()[points[spots]] * powers(_BASE, length + 1)[:length]).sum(1, dtype=np.uint64)))
            piece = np.searchsorted(ends, at, side="right")
            ids.append(np.where(sizes[piece] == length, piece, SUFFIX))
        keys, ids = np.concatenate([np.empty(0, np.uint64), *keys]), np.concatenate([np.empty(0, np.int64), *ids])
        order = np.lexsort((-ids, keys))  # a suffix that is a piece too is a piece
        keys, first = np.unique(keys[order], return_index=True)
        ids = ids[order][first]
        size = 1 << max(10, (16 * len(keys)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.keys, self.ids, self.used = np.zeros(size + 64, np.uint64), np.full(size + 64, NOTHING, np.int32), np.zeros(size + 64, bool)
        slots, left = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):  # the first key of each free slot takes it, the others try the next one
            free = left[~self.used[slots[left]]]
            taken, which = np.unique(slots[free], return_index=True)
            self.keys[taken], self.ids[taken], self.used[taken] = keys[free[which]], ids[free[which]], True
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] += 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, SUFFIX for what is only the end of one, NOTHING else."""
        keys = mix64(hashes)
        slots, out = (keys >> self.shift).astype(np.int64), np.full(len(keys), NOTHING, np.int32)
        left = np.flatnonzero(self.used[slots])
        while len(left):
            spots = slots[left]
            hit = self.keys[spots] == keys[left]
            out[left[hit]] = self.ids[spots[hit]]
            left = left[~hit]
            slots[left] += 1
            left = left[self.used[slots[left]]]
        return out


class Trie:
    """The distinct prefixes of words as nodes, by level; 0 is the root. Each node has the pieces that its prefix may end with."""

    def __init__(self, words: list[str], pieces: Pieces):
        self.pieces = pieces
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
        ends = np.cumsum(sizes)
        depth = np.arange(1, len(points) + 1) - np.repeat(ends - sizes, sizes)
        power = powers(_BASE, int(sizes.max(initial=0)) + 2)
        with np.errstate(over="ignore"):
            upto = np.cumsum(letters()[points] * power[depth - 1])
            before = np.concatenate([np.zeros(1, np.uint64), upto])[ends - sizes]
            prefix = upto - np.repeat(before, sizes)
            mark = mix64(prefix + mix64(depth.astype(np.uint64)))
        _, sample, node = np.unique(mark, return_index=True, return_inverse=True)
        order = np.argsort(depth[sample], kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(1, len(order) + 1)
        node, sample = place[node], sample[order]
        self.terminals = node[ends - 1] if len(words) else np.empty(0, np.int64)
        level = depth[sample]
        starts = np.flatnonzero(np.diff(level, prepend=0)) + 1
        #: The first node of each level, and one after the last.
        self.levels = np.append(starts, len(order) + 1)
        bytes_of = 1 + (points[sample] > 0x7F) + (points[sample] > 0x7FF) + (points[sample] > 0xFFFF)
        # By length: nodes (from 0, without the root), the nodes above them and the pieces between.
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        alive, count = np.arange(len(sample)), np.ones(len(sample), np.int64)
        with np.errstate(over="ignore"):
            inverse = powers(pow(_BASE, -1, 1 << 64), int(sizes.max(initial=0)) + 2)
            for length in range(1, pieces.longest + 1):
                alive = alive[level[alive] >= length]
                spot = sample[alive]
                whole = level[alive] == length
                rest = np.where(whole, np.uint64(0), prefix[spot - length])
                ids = pieces.find((prefix[spot] - rest) * inverse[level[alive] - length])
                hit = ids >= 0
                found.append((alive[hit], np.where(whole[hit], 0, node[spot[hit] - length]), ids[hit]))
                count[alive[hit]] += 1
                alive = alive[ids != NOTHING]  # what no piece ends with, no longer one does
        self.ways = np.concatenate([[0], np.cumsum(count)])
        #: Ways to a node: the node above and the piece between, or less its number of bytes; longer pieces come first.
        self.above, self.piece = np.empty(self.ways[-1], np.int64), np.empty(self.ways[-1], np.int64)
        free = self.ways[:-1].copy()
        for at, above, ids in [*reversed(found), (np.arange(len(sample)), np.where(level > 1, node[sample - 1], 0), -bytes_of)]:
            self.above[free[at]], self.piece[free[at]] = above, ids
            free[at] += 1

    def forward(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best score and token count of each node; the way that gives them is kept."""
        byte = float(scores.min(initial=0.0)) - UNKNOWN
        known = self.piece >= 0
        cost = np.where(known, scores[np.where(known, self.piece, 0)] if len(scores) else 0.0, -self.piece * byte)
        added = np.where(known, 1, -self.piece)
        count = len(self.ways)
        best, tokens, self.chosen = np.zeros(count), np.zeros(count, np.int64), np.zeros(count, np.int64)
        for a, b in zip(self.levels[:-1], self.levels[1:], strict=True):
            firsts = self.ways[a - 1 : b] - self.ways[a - 1]
            ways = slice(self.ways[a - 1], self.ways[b - 1])
            above = self.above[ways]
            reached = best[above] + cost[ways]
            used = tokens[above] + added[ways]
            each = np.repeat(np.arange(b - a), np.diff(firsts))
            best[a:b] = np.maximum.reduceat(reached, firsts[:-1])
            used = np.where(reached == best[a:b][each], used, np.iinfo(np.int64).max)
            tokens[a:b] = np.minimum.reduceat(used, firsts[:-1])
            right = np.flatnonzero(used == tokens[a:b][each])
            self.chosen[a:b][each[right[::-1]]] = ways.start + right[::-1]  # the first way of several
        return best, tokens

    def usage(self, weights: np.ndarray) -> np.ndarray:
        """How often each piece is in the words' segmentations, each word as often as its weight says."""
        flow = np.bincount(self.terminals, weights, len(self.chosen)).astype(np.int64)
        for a, b in zip(self.levels[-2::-1], self.levels[:0:-1], strict=True):
            np.add.at(flow, self.above[self.chosen[a:b]], flow[a:b])
        piece = self.piece[self.chosen[1:]]
        return np.bincount(piece[piece >= 0], flow[1:][piece >= 0], len(self.pieces.names)).astype(np.int64)


def portions(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of words with at most AT_ONCE characters together; a longer word is one by itself."""
    first = size = 0
    for n, word in enumerate(words):
        if size and size + len(word) > AT_ONCE:
            yield first, n
            first, size = n, 0
        size += len(word)
    if words:
        yield first, len(words)


def word_scores(words: list[str], pieces: Pieces, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token count and score of each distinct word, its mark included."""
    counts, totals = np.empty(len(words), np.int64), np.empty(len(words))
    for a, b in portions(words):
        trie = Trie(words[a:b], pieces)
        best, tokens = trie.forward(scores)
        counts[a:b], totals[a:b] = tokens[trie.terminals], best[trie.terminals]
    return counts, totals


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The text of each word, its number among the distinct words, and these."""
    words = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    flat = words.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(there)).dictionary_encode()
    return owner[there], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def sliced(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts, in order, some TEXT_AT_ONCE bytes at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        least = (ends[first - 1] if first else 0) + TEXT_AT_ONCE
        last = max(first + 1, int(np.searchsorted(ends, least, side="right")))
        yield texts.slice(first, last - first)
        first = last


def vocabulary(path: str) -> Pieces:
    """The ordinary pieces of a sentencepiece file, in their order."""

    def made() -> Pieces:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(own.get_piece_size())
        return Pieces([own.id_to_piece(i) for i in ids if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i))])

    return held(("pieces", path), made)


def fitted(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of pieces that occur so often."""
    return np.log((counts + SMOOTH) / (counts.sum() + SMOOTH * max(1, len(counts))))


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n, over all texts; each batch adds up its words before they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in sliced(batch.column("text")):
                _, codes, words = split(texts)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.bincount(codes, minlength=len(words)))], names=["word", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Scores of the pieces after ``rounds`` of hard EM over all words of docs; what reaches the driver is a count for each piece."""
    size = len(vocabulary(path).names)
    words = materialize(word_counts(docs), "words")
    counts = np.zeros(size, np.int64)
    for _ in range(rounds):
        scores = fitted(counts)

        def run(batches: Iterator[pa.RecordBatch], scores: np.ndarray = scores) -> Iterator[pa.RecordBatch]:
            pieces = vocabulary(path)
            total = np.zeros(len(scores), np.int64)
            for batch in batches:
                marked = [START + w for w in batch.column("word").to_pylist()]
                weights = batch.column("n").to_numpy()
                for a, b in portions(marked):
                    trie = Trie(marked[a:b], pieces)
                    trie.forward(scores)
                    total += trie.usage(weights[a:b])
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "n"])

        counts = np.zeros(size, np.int64)
        for r in words.mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            counts[r.piece] = r.n
    drop_stage(words)
    return fitted(counts)


def counts(docs: DataFrame, path: str, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_tokens and score (log probability) of each text, under a model fitted to all of them."""
    bounded_batches(docs.sparkSession)
    scores = fit(docs, path, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path)
        known: dict[str, int] = {}
        tokens, totals = np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for texts in sliced(batch.column("text")):
                owner, codes, words = split(texts)
                if len(known) > REMEMBERED:
                    known, tokens, totals = {}, tokens[:0], totals[:0]
                fresh = [w for w in words if w not in known]
                if fresh:
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                    more = word_scores([START + w for w in fresh], pieces, scores)
                    tokens, totals = np.concatenate([tokens, more[0]]), np.concatenate([totals, more[1]])
                place = np.array([known[w] for w in words], np.int64)[codes]
                sums = (np.bincount(owner, w, len(texts)) for w in (None, tokens[place], totals[place]))
                parts.append(tuple(sums))
            n_words, n_tokens, score = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.empty(0),) * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(n_tokens.astype(np.int64)), pa.array(score)], names=["doc_id", "n_words", "n_tokens", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, score double")
