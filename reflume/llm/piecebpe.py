"""SentencePiece encoding and decoding of merge-type vocabularies by an agenda of adjacent symbol pairs.

A text gets a blank in front, blanks become the word-start mark, and every character is a symbol. The agenda holds
the adjacent pairs whose joined string is a piece, ordered by score, the leftmost first among equal scores; its head is
merged and the pairs that this makes are added, until the agenda is empty. An entry that no longer stands for a pair that
is there is dropped. As no piece of a usual vocabulary has the mark after another character, a pair that crosses a
word's start can't merge, so words are encoded by themselves, each distinct one once: the agendas of many are kept
side by side in one sorted array, whose first entry for each word is merged at each step. Words of over LONG characters have
a heap each; a vocabulary with pieces across words has its texts encoded as one word.

Ids equal those of the sentencepiece library without begin or end ids and sampling, for vocabularies with the identity normalizer,
a dummy prefix and kept white space; others are refused when they are read. In each Arrow batch the words that the task
meets for the first time are given to the library too, and a difference ends the job, so no wrong id is ever returned.
A character that no piece covers becomes its UTF-8 bytes' pieces, or the unknown id without such pieces.

A null text counts as empty and gives no ids. Repeated rows are encoded like others; other columns are kept.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import PairRanks, code_points, ragged, word_hashes
from .common import bounded_batches, held

START = "▁"
#: Characters of a word up to which agendas stand side by side, characters handled at once, words whose agendas are side by side, remembered words.
LONG, AT_ONCE, SIDE_BY_SIDE, REMEMBERED = 200, 1 << 19, 1 << 17, 300_000
#: Kinds of pieces in the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_ABSENT = (1 << 62) - 1
_BITS = 20


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Vocabulary:
    """A file's pieces, their scores and kinds; only what this module encodes exactly is accepted."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        normalizer: dict = {}
        with open(path, "rb") as f:
            for n, value in fields(f.read()):
                if n == 1:
                    piece = dict(fields(value))
                    self.pieces.append(piece[1].decode())
                    self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                    self.kinds.append(piece.get(3, NORMAL))
                elif n == 2:
                    trainer = dict(fields(value))
                elif n == 3:
                    normalizer = dict(fields(value))
        wanted = {"merge type": trainer.get(3) == 2, "identity normalizer": not normalizer.get(2), "dummy prefix": normalizer.get(3, 1) == 1, "kept white space": normalizer.get(4, 1) == 0, "marked blanks": normalizer.get(5, 1) == 1, "blanks before words": trainer.get(24, 0) == 0, "no user-defined or unused pieces": not {USER, UNUSED} & set(self.kinds)}
        if missing := [k for k, there in wanted.items() if not there]:
            raise ValueError(f"{path} isn't a vocabulary with {', '.join(missing)}")
        self.surface = trainer.get(44, b" \xe2\x81\x87 ")


class Coder:
    """One vocabulary: texts to ids and back."""

    def __init__(self, path: str):
        self.path, self._library = path, None
        made = Vocabulary(path)
        size = len(made.pieces)
        normal = {p: i for i, (p, k) in enumerate(zip(made.pieces, made.kinds, strict=True)) if k == NORMAL}
        if size >= 1 << _BITS:
            raise ValueError(f"more than {1 << _BITS} pieces")
        self.words_apart = not any(START in p.lstrip(START) for p in normal)
        byte_of = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(made.pieces, made.kinds, strict=True)) if k == BYTE}
        self.bytes = np.array([byte_of[b] for b in range(256)], np.int32) if len(byte_of) == 256 else None
        self.unknown = made.kinds.index(UNKNOWN)
        #: A symbol for each piece, then one for each character of a piece that is none itself; other characters have OUTSIDE.
        symbols = dict(normal)
        for p in normal:
            for c in p:
                symbols.setdefault(c, size + len(symbols))
        self.outside = (1 << _BITS) - 1
        self.single = np.full(0x110000, self.outside, np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        order = {s: n for n, s in enumerate(sorted({made.scores[i] for i in normal.values()}, reverse=True))}
        #: Both symbols of a pair to the rank of its score and the piece that it becomes.
        self.joins = {(symbols[p[:n]], symbols[p[n:]]): order[made.scores[i]] << _BITS | i for p, i in normal.items() for n in range(1, len(p)) if p[:n] in symbols and p[n:] in symbols}
        self.pairs = PairRanks(self.joins)
        spelled = []
        for p, k in zip(made.pieces, made.kinds, strict=True):
            spelled.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else made.surface if k == UNKNOWN else p.replace(START, " ").encode())
        self.kinds = np.array(made.kinds)
        self.marked = np.array([k == NORMAL and p.startswith(START) for p, k in zip(made.pieces, made.kinds, strict=True)])
        self.spelled, self.spelled_sizes = np.frombuffer(b"".join(spelled), np.uint8), np.array([len(x) for x in spelled])
        self.spelled_at = np.cumsum(self.spelled_sizes) - self.spelled_sizes
        self.pieces = size
        self.decimal = [str(i) for i in range(size)]
        self.forget()

    def forget(self) -> None:
        """Drops the remembered words: hash to where the word's ids are in the pool."""
        self.known: dict[int, int] = {}
        self.pool, self.pool_at, self.pool_sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def library(self):
        if self._library is None:
            import sentencepiece

            self._library = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self._library

    # words

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and piece of each pair, _ABSENT for those that make no piece."""
        return self.pairs.leaves(left.astype(np.int64), right.astype(np.int64), np.zeros(len(left), np.int64), 0)

    def agenda_of_one(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """Symbols that one word's agenda leaves, and where each begins."""
        n = len(symbols)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n)), bytearray(n)
        now: list[int | None] = [None] * n
        agenda: list[tuple[int, int]] = []

        def add(i: int) -> None:
            j = after[i]
            now[i] = made = self.joins.get((symbols[i], symbols[j])) if j < n else None
            if made is not None:
                heapq.heappush(agenda, (made >> _BITS, i))

        for i in range(n):
            add(i)
        while agenda:
            rank, i = heapq.heappop(agenda)
            made = now[i]
            if gone[i] or made is None or made >> _BITS != rank:
                continue
            j = after[i]
            symbols[i] = made & ((1 << _BITS) - 1)
            gone[j], after[i] = 1, after[j]
            before[after[i]] = i
            add(i)
            if before[i] >= 0:
                add(before[i])
        left = [i for i in range(n) if not gone[i]]
        return [symbols[i] for i in left], left

    def agendas(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Merges the symbols of words that lie one after another, in place; true for those that are left."""
        n = len(symbols)
        here = np.ones(n, bool)
        word = np.repeat(np.arange(len(sizes)), sizes)
        begin = np.cumsum(sizes) - sizes
        at = np.arange(n) - begin[word]
        after, before = np.arange(1, n + 1), np.arange(-1, n)  # before has a place for the end
        after[begin + sizes - 1], before[begin] = n, -1
        now = np.full(n + 1, _ABSENT)
        inner = np.flatnonzero(after < n)
        now[inner] = self.joined(symbols[inner], symbols[inner + 1])
        inner = inner[now[inner] != _ABSENT]

        def entries(places: np.ndarray) -> np.ndarray:
            return (word[places] << 2 * _BITS) | (now[places] >> _BITS) << _BITS | at[places]

        agenda = np.sort(entries(inner))
        low = (1 << _BITS) - 1
        while len(agenda):
            of = agenda >> 2 * _BITS
            heads = np.flatnonzero(np.diff(of, prepend=-1))
            i = begin[of[heads]] + (agenda[heads] & low)
            j = after[i]
            symbols[i] = now[i] & low
            here[j] = False
            now[j] = _ABSENT
            k = after[j]
            after[i] = k
            before[k] = i
            more = k < n
            now[i] = _ABSENT
            now[i[more]] = self.joined(symbols[i[more]], symbols[k[more]])
            h = before[i]
            mine = h >= 0
            h, i_of_h = h[mine], i[mine]
            now[h] = self.joined(symbols[h], symbols[i_of_h])
            fresh = np.concatenate([i, h])
            fresh = fresh[now[fresh] != _ABSENT]
            places = begin[of] + (agenda & low)
            kept = agenda[now[places] >> _BITS == (agenda >> _BITS) & low]  # what is stale goes
            agenda = np.concatenate([kept, np.sort(entries(fresh))])
            agenda.sort(kind="stable")  # two sorted runs
            if len(fresh):
                agenda = agenda[np.diff(agenda, prepend=-1) != 0]
        return here

    def words_to_ids(self, text: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of code points at ``at``, in order, and each word's count."""
        counts, parts, order = np.zeros(len(at), np.int64), [], []

        def spelled_out(symbols: np.ndarray, places: np.ndarray, which: np.ndarray, words: np.ndarray) -> None:
            """Keeps the ids of symbols; those that are no pieces become bytes. which: the word of each; words: all of them."""
            odd = np.flatnonzero(symbols >= self.pieces)
            wide = np.ones(len(symbols), np.int64)
            if len(odd) and self.bytes is not None:
                points = text[places[odd]]
                wide[odd] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
                ids = np.repeat(symbols, wide).astype(np.int32)
                data = np.frombuffer("".join(map(chr, points.tolist())).encode(), np.uint8)
                ids[ragged((np.cumsum(wide) - wide)[odd], wide[odd])] = self.bytes[data]
            else:
                ids = np.where(symbols >= self.pieces, self.unknown, symbols).astype(np.int32)
            counts[words] = np.bincount(np.repeat(which, wide), minlength=len(words))
            parts.append(ids)
            order.append(words)

        short = np.flatnonzero(sizes <= LONG)
        for a in range(0, len(short), SIDE_BY_SIDE):
            rows = short[a : a + SIDE_BY_SIDE]
            places = ragged(at[rows], sizes[rows])
            symbols = self.single[text[places]].astype(np.int64)
            here = self.agendas(symbols, sizes[rows])
            spelled_out(symbols[here], places[here], np.repeat(np.arange(len(rows)), sizes[rows])[here], rows)
        for row in np.flatnonzero(sizes > LONG).tolist():
            own = self.single[text[at[row] : at[row] + sizes[row]]]
            symbols, left = self.agenda_of_one(own.tolist())
            spelled_out(np.array(symbols, np.int64), at[row] + np.array(left, np.int64), np.zeros(len(left), np.int64), np.array([row]))
        if not parts:
            return np.empty(0, np.int32), counts
        rows, ids = np.concatenate(order), np.concatenate(parts)
        ends = np.cumsum(counts[rows])
        begin = np.empty(len(at), np.int64)
        begin[rows] = ends - counts[rows]
        return ids[ragged(begin, counts)], counts

    def check(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Compares words (with their marks) and their ids with the library's."""
        theirs = self.library().encode([w.replace(START, " ")[1:] if w[0] == START and len(w) > 1 else None for w in words if len(w) > 1 and w[0] == START], num_threads=1)
        bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
        own = [ids[a:b].tolist() for w, a, b in zip(words, bounds[:-1], bounds[1:], strict=True) if len(w) > 1 and w[0] == START]
        if own != theirs:
            word = next(w for w, a, b in zip([w for w in words if len(w) > 1 and w[0] == START], own, theirs, strict=True) if a != b)
            raise ValueError(f"the library has other ids for {word[:100]!r}")

    # texts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        batch, size = [], 0
        for text in texts:
            batch.append(text or "")
            size += len(batch[-1])
            if size >= AT_ONCE:
                out += self._encode(batch)
                batch, size = [], 0
        return out + self._encode(batch)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        marked = [f" {t}".replace(" ", START) if t else "" for t in texts]
        lengths = np.array([len(t) for t in marked], np.int64)
        whole = "".join(marked)
        if not whole:
            return [np.empty(0, np.int32) for _ in texts]
        text = code_points(whole)
        begins = np.cumsum(lengths) - lengths
        fresh = np.zeros(len(text), bool)
        if self.words_apart:
            mark = text == ord(START)
            fresh[1:] = mark[1:] & ~mark[:-1]
        fresh[begins[lengths > 0]] = True
        at = np.flatnonzero(fresh)
        sizes = np.diff(np.append(at, len(text)))
        distinct, sample, which = np.unique(word_hashes(text, at, sizes), return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        places = np.array([self.known.get(h, -1) for h in distinct.tolist()])
        if len(unknown := np.flatnonzero(places < 0)):
            word_at, word_sizes = at[sample[unknown]], sizes[sample[unknown]]
            ids, counts = self.words_to_ids(text, word_at, word_sizes)
            self.check([whole[a : a + n] for a, n in zip(word_at.tolist(), word_sizes.tolist(), strict=True)], ids, counts)
            places[unknown] = np.arange(len(self.known), len(self.known) + len(unknown))
            self.known.update(zip(distinct[unknown].tolist(), places[unknown].tolist(), strict=True))
            self.pool_at = np.concatenate([self.pool_at, len(self.pool) + np.cumsum(counts) - counts])
            self.pool, self.pool_sizes = np.concatenate([self.pool, ids]), np.concatenate([self.pool_sizes, counts])
        places = places[which]
        counts = self.pool_sizes[places]
        ids = self.pool[ragged(self.pool_at[places], counts)]
        upto = np.concatenate([[0], np.cumsum(counts)])
        bounds = upto[np.searchsorted(at, np.append(begins, len(text)))].tolist()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def decode(self, lists: list[np.ndarray]) -> list[str]:
        """Texts of the ids: the first mark goes, bytes that aren't UTF-8 become U+FFFD each, control ids nothing."""
        lists = [np.asarray(x, np.int64) for x in lists]
        ids = np.concatenate([np.empty(0, np.int64), *lists])
        sizes = self.spelled_sizes[ids]
        data = self.spelled[ragged(self.spelled_at[ids], sizes)].tobytes()
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        cuts = np.flatnonzero(self.kinds[ids] == CONTROL)  # the bytes beside one aren't joined
        out = []
        for own, a, b in zip(lists, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            said = next((i for i in own.tolist() if self.kinds[i] != CONTROL), None)
            between = upto[cuts[np.searchsorted(cuts, a) : np.searchsorted(cuts, b)]].tolist()
            start = int(upto[a]) + int(said is not None and self.marked[said])
            places = [start, *(max(start, x) for x in between), int(upto[b])]
            out.append("".join(valid(data[x:y]) for x, y in zip(places[:-1], places[1:], strict=True)))
        return out


def valid(data: bytes) -> str:
    """The text of UTF-8, U+FFFD for each byte that isn't."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return "".join("\ufffd" if 0xDC80 <= ord(c) <= 0xDCFF else c for c in data.decode("utf-8", "surrogateescape"))


def coder(path: str) -> Coder:
    return held(("pieces", path), lambda: Coder(path))


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of every text as an array of ints; a column of that name is replaced."""
    schema = T.StructType([f for f in docs.schema if f.name != out]).add(out, T.ArrayType(T.IntegerType()))
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            lists = own.encode(batch.column(text).to_pylist())
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *lists])))
            kept = [c for c in batch.schema.names if c != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ids], names=[*kept, out])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of every array of ids; null arrays give the empty text, and a column of that name is replaced."""
    schema = T.StructType([f for f in docs.schema if f.name != out]).add(out, T.StringType())
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            texts = own.decode([np.array(x or [], np.int64) for x in batch.column(ids).to_pylist()])
            kept = [c for c in batch.schema.names if c != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, out])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id with the digests of a text's ids, as decimal numbers joined by commas, and of the text decoded from them, in one pass."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def sha(data: str) -> str:
        return hashlib.sha256(data.encode()).hexdigest()

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        decimal = own.decimal
        for batch in batches:
            rows, size, texts = [], 0, []

            def flush() -> None:
                lists = own.encode(texts)
                rows.extend((len(x), sha(",".join([decimal[i] for i in x.tolist()])), sha(t)) for x, t in zip(lists, own.decode(lists), strict=True))
                texts.clear()

            for value in batch.column(text):
                texts.append(value.as_py())
                size += len(texts[-1] or "")
                if size >= AT_ONCE:
                    flush()
                    size = 0
            flush()
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
