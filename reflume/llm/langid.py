"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text of each language accepts every substring of it. A text
is parsed against it into phrases, each the longest match with the labelled text; phrases
times the log of the labelled length over the text's length estimates the cross entropy.
The language with the least is predicted.

Letters are lower-cased and everything else is one space, whatever stands there. Going back to
the root at each phrase makes the parse a deterministic automaton that counts phrases, so segments of
many texts are parsed side by side. Where a segment has one before it, it is parsed anew from that
one's last state until both parses meet, so the phrases are those of one parse of the whole text.

Null texts and texts without a letter get ``und`` with score 0. Ties go to the language
that sorts first. Without labelled rows every text gets ``und``. Repeated rows are
predicted each.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, held

#: Bounds of what is learned from: for each language so many texts, of each at most so many characters from its first letter on.
SAMPLE_TEXTS, SAMPLE_CHARS = 60, 1500
SEGMENT, AT_ONCE = 512, 1 << 19
UNKNOWN = "und"
#: Bits of a letter that a language's sample lacks, at least, however small the sample.
LETTER_BITS = 16.0
#: Symbols of the parts by which a text is in learned languages or not.
PART = 64
#: Bits a symbol beyond which a text is in none of the languages, each part by the language it costs least in, and
#: bits that a whole part in a learned language stays within, whatever stands around it.
MOST_BITS, CLEAR_BITS = 8.0, 4.0


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids that nothing is learned from; null ids belong to it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(language, labelled text), sorted: of at most SAMPLE_TEXTS texts a language, the first by a hash of doc_id, SAMPLE_CHARS characters each."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "text")
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    parts = known.select("doc_id", "lang", F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, SAMPLE_CHARS).alias("text"))
    rows = parts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_TEXTS).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.n)):
        texts.setdefault(r.lang, []).append(r.text)
    return [(lang, "\n".join(parts)) for lang, parts in texts.items()]


def plain(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(text: Sequence[int], symbols: int) -> np.ndarray:
    """Transitions of the suffix automaton by state (rows, 0 is the root) and symbol, -1 where there is none."""
    none = array("i", [-1]) * symbols
    go, link, size, last = array("i", none), [-1], [0], 0
    for c in text:
        new, at = len(link), last
        go.extend(none)
        link.append(0)
        size.append(size[last] + 1)
        while at >= 0 and go[at * symbols + c] < 0:
            go[at * symbols + c] = new
            at = link[at]
        if at >= 0:
            to = go[at * symbols + c]
            if size[to] == size[at] + 1:
                link[new] = to
            else:
                copy = len(link)
                go.extend(go[to * symbols : (to + 1) * symbols])
                size.append(size[at] + 1)
                link.append(link[to])
                while at >= 0 and go[at * symbols + c] == to:
                    go[at * symbols + c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return np.frombuffer(go, np.int32).reshape(-1, symbols)


class Parser:
    """Counts of phrases of texts against each language."""

    def __init__(self, labelled: tuple[tuple[str, str], ...]):
        texts = [plain(t) for _, t in labelled]
        self.languages = [lang for lang, _ in labelled]
        letters = sorted({c for t in texts for c in t if c != " "})
        #: Symbols: 0 is the space, the last one any letter that no language has.
        self.symbols = len(letters) + 2
        self.table = np.zeros(0x110000, np.uint8 if self.symbols < 256 else np.uint16)
        alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.table[alpha] = self.symbols - 1
        for n, c in enumerate(letters):
            self.table[ord(c)] = n + 1
        #: By language: its own number of each symbol, the last one for letters that it lacks. Steps are twice the
        #: place of the state that follows, plus one where a phrase starts, by state and own symbol, language after language.
        self.own = np.zeros((len(texts), self.symbols), np.uint8 if self.symbols < 256 else np.uint16)
        steps, roots, base = [], [], 0
        for row, text in zip(self.own, texts, strict=True):
            number = {c: n for n, c in enumerate([" ", *sorted(set(text) - {" "})])}
            width = len(number) + 1
            row[:] = [number.get(c, width - 1) for c in [" ", *letters, ""]]
            go = automaton([number[c] for c in text], width)
            # One state more: nothing read yet, or a letter that no phrase goes on from. Each step from it starts a phrase.
            again = np.where(go[0] >= 0, go[0], len(go)).astype(np.int32)
            kind = np.int32 if base + (len(go) + 1) * width < 1 << 30 else np.int64
            step = np.empty((len(go) + 1, width), kind)
            np.multiply(np.where(go < 0, again, go), kind(2 * width), out=step[:-1], dtype=kind)
            step[:-1] |= go < 0
            step[-1] = again.astype(kind) * (2 * width) | 1
            step += kind(2 * base)
            steps.append(step.ravel())
            roots.append(base + len(go) * width)
            base += step.size
        self.steps = np.concatenate(steps) if steps else np.empty(0, np.int32)
        self.roots = np.array(roots, self.steps.dtype)
        self.bits = np.array([math.log2(len(t) + 2) for t in texts])
        #: Letters that a language (rows) lacks, by symbol.
        self.lacks = np.array([[n > 0 and c not in own for n, c in enumerate([" ", *letters, ""])] for own in map(set, texts)], bool).reshape(len(texts), self.symbols)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each language (rows) and text, and the texts' lengths in symbols."""
        counts, _, owner, _, sizes = self.parsed(texts)
        return self.by_text(counts, owner, len(texts)), sizes

    @staticmethod
    def by_text(values: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
        """Sums over the parts of each text."""
        return np.array([np.bincount(owner, row, count) for row in values], values.dtype).reshape(len(values), count)

    def walked(self, symbols: np.ndarray, at: np.ndarray, size: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """The step at each place (rows) of each segment (columns) in each language (between), as one parse of each text from its first symbol on takes them.

        All segments are first parsed from the root, side by side. Then those that an earlier segment of
        their text (prior, or -1) goes on into are parsed anew from where it ends, up to the place where
        both parses are in one state, and so on until each segment begins where its prior ends.
        """
        longest, many, count = int(size[0]) if len(size) else 0, len(self.roots), len(at)
        own = self.own[:, symbols].ravel()
        at = np.arange(many)[:, None] * len(symbols) + at
        path = np.zeros((longest, many, count), self.steps.dtype)
        state = np.repeat(self.roots[:, None], count, 1)
        lanes = np.searchsorted(-size, -np.arange(longest), side="left").tolist()
        for t, n in enumerate(lanes):
            step = self.steps[state[:, :n] + own[at[:, :n] + t]]
            path[t, :, :n] = step
            state[:, :n] = step >> 1
        begun, follows = np.repeat(self.roots[:, None], count, 1), np.flatnonzero(prior >= 0)
        flat, at = path.reshape(longest, many * count), at.ravel()
        ends = size[prior[follows]] - 1
        while True:
            wanted = path[ends, :, prior[follows]].T >> 1
            of, which = np.nonzero(wanted != begun[:, follows])
            if not len(of):
                return path
            state = wanted[of, which]
            begun[of, follows[which]] = state
            lane = of * count + follows[which]
            place, left = at[lane], size[follows[which]]
            for t in range(longest):
                step = self.steps[state + own[place + t]]
                before, flat[t, lane] = flat[t, lane], step
                state = step >> 1
                on = (before >> 1 != state) & (t + 1 < left)
                if not on.all():
                    lane, place, left, state = lane[on], place[on], left[on], state[on]
                    if not len(lane):
                        break

    def parsed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that start in and letters that lack, of each language (rows) and part of PART symbols; the parts' texts and sizes, the texts' sizes."""
        lengths = np.array([len(t) for t in texts])
        symbols = self.table[np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)]
        begins = np.cumsum(lengths) - lengths
        kept = np.ones(len(symbols), bool)
        kept[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        first = begins[lengths > 0]
        kept[first] = symbols[first] != 0
        upto = np.concatenate([[0], np.cumsum(kept)])
        symbols, begins, sizes = symbols[kept], upto[begins], upto[begins + lengths] - upto[begins]
        cuts = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), cuts)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        at = begins[owner] + part * SEGMENT
        size = np.minimum(SEGMENT, sizes[owner] - part * SEGMENT)
        order = np.argsort(-size, kind="stable")
        lane = np.empty_like(order)
        lane[order] = np.arange(len(order))
        prior = np.where(part > 0, lane[np.arange(len(order)) - 1], -1)[order] if len(order) else order
        at, owner, size = at[order], owner[order], size[order]
        longest = int(size[0]) if len(size) else 0
        rows = range(0, longest, PART)
        held = [int(np.searchsorted(-size, -k, side="left")) for k in rows]
        none = np.empty(0, np.int64)
        starts = np.concatenate([none, *(at[:n] + k for k, n in zip(rows, held, strict=True))])
        of = np.concatenate([none, *(owner[:n] for n in held)])
        long = np.concatenate([none, *(np.minimum(PART, size[:n] - k) for k, n in zip(rows, held, strict=True))])
        path = self.walked(symbols, at, size, prior)
        phrases = np.concatenate([np.empty((len(self.roots), 0), np.int64), *((path[k : k + PART, :, :n] & 1).sum(0) for k, n in zip(rows, held, strict=True))], axis=1)
        place = np.argsort(starts)
        lacking = np.zeros_like(phrases)
        odd = np.flatnonzero(self.lacks.any(0)[symbols])
        part_of = place[np.searchsorted(starts[place], odd, side="right") - 1]
        for row, lacks in zip(lacking, self.lacks, strict=True):
            row += np.bincount(part_of[lacks[symbols[odd]]], minlength=len(row))
        return phrases, lacking, of, long, sizes

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, bits a symbol, known) of each text; the score is by how much the best beats the second.

        The bits leave one phrase out, as every text has one, so that a short text isn't taken for a strange one.
        Known are texts whose parts cost little, each in the language it costs least in, and those with a part that is clearly in one.
        """
        lowered = [(t or "").lower() for t in texts]
        if not self.languages:
            return [(UNKNOWN, 0.0, None, False)] * len(texts)
        counts, lacking, owner, long, sizes = self.parsed(lowered)
        each = counts * self.bits[:, None] + lacking * np.maximum(0, LETTER_BITS - self.bits)[:, None]
        costs = self.by_text(each, owner, len(texts))
        rates = costs / np.maximum(sizes, 1)
        best = np.argmin(rates, axis=0)
        ordered = np.sort(rates, axis=0)
        second = ordered[1] if len(ordered) > 1 else np.full(len(texts), np.inf)
        fresh = (costs[best, np.arange(len(texts))] - self.bits[best]) / np.maximum(sizes, 1)
        least = each.min(axis=0)
        clear = np.bincount(owner, (long == PART) & (least <= CLEAR_BITS * PART), len(texts)) > 0
        mixed = (np.bincount(owner, least, len(texts)) - self.bits[best]) / np.maximum(sizes, 1)
        known = (sizes > 0) & (clear | (mixed <= MOST_BITS))
        with np.errstate(invalid="ignore"):
            scores = np.where(np.isinf(second), 1.0, 1 - ordered[0] / np.maximum(second, 1e-300))
        return [(self.languages[b], float(s), float(r), bool(k)) if n else (UNKNOWN, 0.0, None, False) for b, s, r, k, n in zip(best, scores, fresh, known, sizes, strict=True)]


def parser(labelled: tuple[tuple[str, str], ...]) -> Parser:
    return held(("parser", labelled), lambda: Parser(labelled))


def predicted(text: Column, labelled: list[tuple[str, str]]) -> Column:
    """A struct of lang_pred, score, bits (a symbol, by the predicted language) and known for each text; only texts go to Python."""
    learned = tuple(labelled)

    @F.arrow_udf("struct<lang_pred:string,score:double,bits:double,known:boolean>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = parser(learned)
        for column in columns:
            out, texts, size = [], [], 0
            for value in column:
                texts.append(value.as_py())
                size += len(texts[-1] or "")
                if size >= AT_ONCE:
                    out += own.predict(texts)
                    texts, size = [], 0
            out += own.predict(texts) if texts else []
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)], names=["lang_pred", "score", "bits", "known"])

    return run(text)


def accept(docs: DataFrame) -> DataFrame:
    """docs without those in no learned language: undetermined ones, and those of which no part is in any, nor all parts together within MOST_BITS a symbol.

    Rows are kept as they are, whatever their columns are called; repeated rows go or stay alike. Where no row
    has a label, nothing is learned and all documents stay.
    """
    labelled = sample(docs)
    if not labelled:
        return docs
    bounded_batches(docs.sparkSession)
    packed = docs.select(F.struct(*docs.columns).alias("_doc"))
    found = packed.withColumn("_found", predicted(F.col("_doc.text").cast("string"), labelled))
    return found.where((F.col("_found.lang_pred") != UNKNOWN) & F.col("_found.known")).select("_doc.*")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits: learned from the labelled rows that aren't held out."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(F.col("text"), sample(docs)).alias("_found"))
    return found.select("doc_id", "held_out", "_found.lang_pred", "_found.score", "_found.bits")
