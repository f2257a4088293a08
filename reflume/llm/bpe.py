"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of a word's tree hold the merge ranks of its adjacent symbol pairs; each inner
node holds the smaller of its children, so the root names the lowest rank, leftmost on
ties. A merge changes three leaves and the nodes above them; merging ends when the root
holds none. Distinct words of a batch are merged side by side, one tree a row of an array;
words of over LONG bytes get a tree of their own.

Vocabularies are the JSON files of the tokenizers library, byte-level, with or without an
end-of-word suffix; ids and decoded texts equal that library's with add_special_tokens
off. That library is asked for the class of each code point that this Python's Unicode tables lack, once.
Special tokens' strings within a text become their ids, as there. A null text counts
as empty and gives no ids. Repeated rows are encoded like others.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import bounded_batches, held, powers, random_words

#: Bytes of a word up to which words share an array of trees, characters handled at once, and remembered words.
LONG, AT_ONCE, REMEMBERED = 120, 1 << 19, 300_000
OTHER, LETTER, NUMBER, SPACE, UNASSIGNED = range(5)
#: What may follow an apostrophe as a token of its own, and Unicode's White_Space.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
NONE, NOTHING = np.int64((1 << 62) - 1), 0xFFFFF


@lru_cache(1)
def classes() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE for each code point, or UNASSIGNED in this Python's version of Unicode."""
    def of(kind: str) -> int:
        return UNASSIGNED if kind == "Cn" else {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)

    table = np.fromiter((of(unicodedata.category(chr(c))) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


@lru_cache(1)
def letter_hashes() -> np.ndarray:
    return random_words(21, 0x110000)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class PairRanks:
    """(left id, right id) to merge rank for arrays, by open addressing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(10, (len(pairs) * 16).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks, self.probes = np.full(size + 64, -1, np.int64), np.zeros(size + 64, np.int64), 1
        keys = np.array([a << 20 | b for a, b in pairs], np.int64).reshape(-1)
        for key, slot, rank in zip(keys.tolist(), self.slots(keys).tolist(), pairs.values(), strict=True):
            probe = 0
            while self.keys[slot + probe] >= 0:
                probe += 1
            self.keys[slot + probe], self.ranks[slot + probe] = key, rank
            self.probes = max(self.probes, probe + 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, shift: int) -> np.ndarray:
        """rank << shift | at, or NONE."""
        keys = left << 20 | right
        slots, out = self.slots(keys), np.full(len(keys), NONE)
        for probe in range(self.probes):
            hit = np.flatnonzero(self.keys[slots + probe] == keys)
            out[hit] = self.ranks[slots[hit] + probe] << shift | at[hit]
        return out


class Coder:
    """One vocabulary: texts to ids and back."""

    def __init__(self, path: str):
        self.path, self._library = path, None
        #: Classes of code points; those that are unassigned here are asked for when they first come.
        self.kinds = classes().copy()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.suffix = suffix
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs: dict[tuple[int, int], int] = {}
        merged = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs.setdefault((vocab[a], vocab[b]), rank)
            merged.append(vocab[a + b])
        self.pairs, self.merged, self.ranks = pairs, np.array(merged, np.int64), PairRanks(pairs)
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.spelled = [b""] * size
        for piece, i in vocab.items():
            ends = bool(suffix) and piece.endswith(suffix)
            self.spelled[i] = bytes(byte_of[c] for c in (piece[: -len(suffix)] if ends else piece)) + b" " * ends
        for piece, i in self.special.items():
            self.spelled[i] = piece.encode()
        self.spelled_bytes = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.spelled_sizes = np.array([len(x) for x in self.spelled])
        self.spelled_at = np.cumsum(self.spelled_sizes) - self.spelled_sizes
        #: Remembered words: their hash to where their ids are in the pool.
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool, self.pool_at, self.pool_sizes, self.pool_next = [], [], [], 0

    def library(self) -> Tokenizer:
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
        return self._library

    def learn(self, points: np.ndarray) -> None:
        """Finds out which class the library has these unassigned code points in: letters join letters, other signs join signs."""
        cut = self.library().pre_tokenizer.pre_tokenize_str
        for c in np.unique(points).tolist():
            if len(cut(f"a{chr(c)}a")) == 1:
                self.kinds[c] = LETTER
            else:
                self.kinds[c] = OTHER if len(cut(f"!{chr(c)}!")) == 1 else NUMBER

    # words

    def starts(self, text: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of code points, none of which crosses a segment's start."""
        size, kind = len(text), self.kinds[text]
        fresh = np.ones(size + 1, bool)
        fresh[1:size] = kind[1:] != kind[:-1]
        fresh[segments] = True
        first = np.zeros(size + 1, bool)
        first[segments] = first[size] = True
        if not self.suffix:  # white space is kept; a blank joins the word that follows
            runs = np.flatnonzero(fresh)
            ends = runs[1:][(kind[runs[:-1]] == SPACE)]
            ends = ends[~first[ends]]
            fresh[ends - 1] = True
            fresh[ends[text[ends - 1] == 0x20]] = False
        else:
            fresh[:size] |= kind == NUMBER
            fresh[1:size] |= kind[:-1] == NUMBER
        quotes = np.flatnonzero(text[: size - 1] == 0x27) if size > 1 else np.empty(0, np.int64)
        quotes = quotes[fresh[quotes] & (kind[quotes + 1] == LETTER) & ~first[quotes + 1]]
        # a quote after another sign goes on with it, so it isn't fresh
        wide = np.concatenate([text, [0, 0]])
        ended = np.concatenate([first, [True]])
        for suffix in SUFFIXES:
            a, rest = ord(suffix[0]), suffix[1:]
            fits = wide[quotes + 1] == a
            if rest:
                fits &= (wide[quotes + 2] == ord(rest)) & ~ended[quotes + 2]
            at = quotes[fits]
            fresh[at + 1] = False
            fresh[at + 1 + len(suffix)] = True
            quotes = quotes[~fits]
        at = np.flatnonzero(fresh[:size])
        ends = np.append(at[1:], size)
        if self.suffix:
            kept = kind[at] != SPACE
            at, ends = at[kept], ends[kept]
        return at, ends

    def merge_long(self, ids: list[int]) -> list[int]:
        """One word's merges by a tree of its own."""
        n = len(ids)
        leaves = 1 << max(1, (n - 1).bit_length())
        shift, none = leaves.bit_length(), int(NONE)

        def leaf(i: int, j: int) -> int:
            rank = self.pairs.get((ids[i], ids[j])) if j < n else None
            return none if rank is None else rank << shift | i

        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            tree[leaves + i] = leaf(i, i + 1)
        for x in range(leaves - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])
        after, before, gone = list(range(1, n + 1)), list(range(-1, n)), [False] * n
        while tree[1] != none:
            i = tree[1] & ((1 << shift) - 1)
            j = after[i]
            ids[i] = int(self.merged[tree[1] >> shift])
            gone[j], after[i] = True, after[j]
            before[after[i]] = i
            changed = [(j, none), (i, leaf(i, after[i]))]
            if before[i] >= 0:
                changed.append((before[i], leaf(before[i], i)))
            for x, value in changed:
                x += leaves
                tree[x] = value
                while x > 1:
                    x >>= 1
                    tree[x] = min(tree[2 * x], tree[2 * x + 1])
        return [x for x, lost in zip(ids, gone, strict=True) if not lost]

    def merge_rows(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges of many words side by side. Row r has its symbols in columns 1 .. sizes[r].

        Returns the ids of all rows, one after another, and how many each row has.
        """
        rows, wide = symbols.shape
        leaves = 1 << (wide - 1).bit_length()
        shift = leaves.bit_length()
        mask = (1 << shift) - 1
        columns = np.arange(wide)
        tree = np.full((rows, 2 * leaves), NONE)
        pair_at = np.tile(columns[:-1], rows)
        tree[:, leaves : leaves + wide - 1] = self.ranks.leaves(symbols[:, :-1].ravel(), symbols[:, 1:].ravel(), pair_at, shift).reshape(rows, wide - 1)
        width = leaves
        while width > 1:
            width //= 2
            level = tree[:, 2 * width : 4 * width]
            tree[:, width : 2 * width] = np.minimum(level[:, ::2], level[:, 1::2])
        after = np.tile(columns + 1, (rows, 1))
        before = np.tile(columns - 1, (rows, 1))
        here = (columns >= 1) & (columns <= sizes[:, None])
        flat, ids, after, before, kept = tree.ravel(), symbols.ravel(), after.ravel(), before.ravel(), here.ravel()
        live = np.arange(rows)
        while True:
            best = flat[live * (2 * leaves) + 1]
            going = best != NONE
            live, best = live[going], best[going]
            if not len(live):
                break
            root, row = live * (2 * leaves), live * wide
            i = best & mask
            j = after[row + i]
            k = after[row + j]
            h = before[row + i]
            new = self.merged[best >> shift]
            ids[row + i] = new
            kept[row + j] = False
            after[row + i] = k
            before[row + k] = i
            flat[root + leaves + j] = NONE
            flat[root + leaves + i] = self.ranks.leaves(new, ids[row + k], i, shift)
            flat[root + leaves + h] = self.ranks.leaves(ids[row + h], new, h, shift)
            nodes = [leaves + x for x in (i, j, h)]
            for _ in range(leaves.bit_length() - 1):
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    low = root + 2 * x
                    flat[root + x] = np.minimum(flat[low], flat[low + 1])
        return ids[kept], kept.reshape(rows, wide).sum(1)

    def words_to_ids(self, data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that lie in UTF-8 bytes at ``at`` with ``sizes`` bytes, in order, and each word's count."""
        counts, parts, order = np.zeros(len(at), np.int64), [], []
        for low, high in ((0, 6), (6, 14), (14, 30), (30, LONG)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if not len(rows):
                continue
            width = int(sizes[rows].max())
            columns = np.arange(width)
            there = columns < sizes[rows, None]
            table = np.full((len(rows), width + 2), NOTHING, np.int64)
            spots = np.where(there, at[rows, None] + columns, 0)
            table[:, 1:-1] = np.where(there, self.first[data[spots]], NOTHING)
            table[np.arange(len(rows)), sizes[rows]] = self.last[data[at[rows] + sizes[rows] - 1]]
            ids, counts[rows] = self.merge_rows(table, sizes[rows])
            parts.append(ids)
            order.append(rows)
        for row in np.flatnonzero(sizes > LONG).tolist():
            word = data[at[row] : at[row] + sizes[row]]
            ids = self.merge_long([*self.first[word[:-1]].tolist(), int(self.last[word[-1]])])
            counts[row] = len(ids)
            parts.append(np.array(ids, np.int64))
            order.append(np.array([row]))
        if not parts:
            return np.empty(0, np.int64), counts
        rows, ids = np.concatenate(order), np.concatenate(parts)
        ends = np.cumsum(counts[rows])
        begin = np.empty(len(at), np.int64)
        begin[rows] = ends - counts[rows]
        return ids[ragged(begin, counts)], counts

    # texts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
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
        marked = {i: self.cut(t) for i, t in enumerate(texts) if any(s in t for s in self.special)}
        if not marked:
            return self._plain(texts)
        pieces = [p for i, t in enumerate(texts) for p in (marked[i][0] if i in marked else [t])]
        done, out = iter(self._plain(pieces)), []
        for i in range(len(texts)):
            parts = [next(done)]
            for token in marked[i][1] if i in marked else ():
                parts += [np.array([token], np.uint32), next(done)]
            out.append(np.concatenate(parts))
        return out

    def cut(self, text: str) -> tuple[list[str], list[int]]:
        """The text around special tokens' strings, and those tokens."""
        pieces, tokens, at = [], [], 0
        while found := [(p, -len(s), s) for s in self.special if (p := text.find(s, at)) >= 0]:
            p, _, s = min(found)
            pieces.append(text[at:p])
            tokens.append(self.special[s])
            at = p + len(s)
        return [*pieces, text[at:]], tokens

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        if self.suffix:
            texts = [normal(t) if t.isascii() or (classes()[code_points(t)] != UNASSIGNED).all() else self.library().normalizer.normalize_str(t) for t in texts]
        lengths = np.array([len(t) for t in texts], np.int64)
        whole = "".join(texts)
        if not whole:
            return [np.empty(0, np.uint32) for _ in texts]
        text = code_points(whole)
        if (unknown := text[self.kinds[text] == UNASSIGNED]).size:
            self.learn(unknown)
        begins = np.cumsum(lengths) - lengths
        at, ends = self.starts(text, begins[lengths > 0])
        sizes = ends - at
        if not len(at):
            return [np.empty(0, np.uint32) for _ in texts]
        hashes = word_hashes(text, at, sizes)
        distinct, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        known = self.known
        places = np.array([known.get(h, -1) for h in distinct.tolist()])
        if len(unknown := np.flatnonzero(places < 0)):
            data = np.frombuffer(whole.encode(), np.uint8)
            if len(data) == len(text):
                byte_at, byte_sizes = at[sample[unknown]], sizes[sample[unknown]]
            else:
                width = 1 + (text > 0x7F) + (text > 0x7FF) + (text > 0xFFFF)
                upto = np.concatenate([[0], np.cumsum(width)])
                byte_at = upto[at[sample[unknown]]]
                byte_sizes = upto[ends[sample[unknown]]] - byte_at
            ids, counts = self.words_to_ids(data, byte_at, byte_sizes)
            self.pool.append(ids.astype(np.uint32))
            self.pool_sizes.append(counts)
            self.pool_at.append(self.pool_next + np.cumsum(counts) - counts)
            self.pool_next += len(ids)
            places[unknown] = np.arange(len(known), len(known) + len(unknown))
            known.update(zip(distinct[unknown].tolist(), places[unknown].tolist(), strict=True))
            self.pool, self.pool_sizes, self.pool_at = ([np.concatenate(x)] for x in (self.pool, self.pool_sizes, self.pool_at))
        places = places[which]
        counts = self.pool_sizes[0][places]
        ids = self.pool[0][ragged(self.pool_at[0][places], counts)]
        upto = np.concatenate([[0], np.cumsum(counts)])
        bounds = upto[np.searchsorted(at, np.append(begins, len(text)))].tolist()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def decode(self, lists: list[np.ndarray]) -> list[str]:
        """Texts of the ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        ids = np.concatenate([np.empty(0, np.int64), *lists]).astype(np.int64)
        sizes = self.spelled_sizes[ids]
        data = self.spelled_bytes[ragged(self.spelled_at[ids], sizes)].tobytes()
        upto = np.concatenate([[0], np.cumsum(sizes)])
        bounds = upto[np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.int32)


def ragged(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """at[0] .. at[0] + sizes[0] - 1, at[1] .. and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + sizes, sizes)


def word_hashes(text: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of code points."""
    power = powers(0xD1342543DE82EF95, int(sizes.max()))
    spots = ragged(at, sizes)
    with np.errstate(over="ignore"):
        values = letter_hashes()[text[spots]] * power[ragged(np.zeros(len(at), np.int64), sizes)]
        return np.add.reduceat(values, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64)


def normal(text: str) -> str:
    """NFC, then each character in lower case, whatever surrounds it."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def coder(path: str) -> Coder:
    return held(("coder", path), lambda: Coder(path))


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of every text as an array of ints; a column of that name is replaced."""
    schema = T.StructType([f for f in docs.schema if f.name != out]).add(out, T.ArrayType(T.IntegerType()))

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            lists = own.encode(batch.column(text).to_pylist())
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint32), *lists]).astype(np.int32)))
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


def digests(docs: DataFrame, path: str, text: str = "text", kept: tuple[str, ...] = ()) -> DataFrame:
    """doc_id with the digests of a text's ids and of the text decoded from them, in one pass, and columns of docs that are kept."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def sha(data) -> str:
        return hashlib.sha256(data).hexdigest()

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            rows, size, texts = [], 0, []

            def flush() -> None:
                lists = own.encode(texts)
                rows.extend((len(x), sha(x.astype("<u4").tobytes()), sha(t.encode())) for x, t in zip(lists, own.decode(lists), strict=True))
                texts.clear()

            for value in batch.column(text):
                texts.append(value.as_py())
                size += len(texts[-1] or "")
                if size >= AT_ONCE:
                    flush()
                    size = 0
            flush()
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            made = [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([*made, *(batch.column(c) for c in kept)], names=[*schema.names, *kept])

    others = "".join(f", {c} {t}" for c, t in docs.select(*kept).dtypes)
    return docs.select("doc_id", text, *kept).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + others)
