"""Token ids as binary files whose document boundaries are Elias-Fano encoded.

A shard file holds the ids of its documents one after another, two bytes each if the
vocabulary allows and else four, then a footer: the boundaries (n + 1 offsets) and the
document ids, both Elias-Fano encoded, as they never descend. Elias-Fano keeps the low
bits of each value packed and its high bits in unary, about 2 + log2(u / n) bits a value.
Select finds the i-th one bit from 32-bit counts, one for each BLOCK bits, and a look
into one block, so a document's offset is read without a table of 64-bit offsets.

    magic, ids ..., footer, footer's size (8 bytes), magic

Documents lie in ascending doc_id order; rows with equal ids are ordered by text and null
ids come first. Null and empty texts have only the end id. Repeated rows are written
each. An empty table gives no shard. Files appear under their final names complete, so a
task that runs again replaces them with the same bytes.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenizers import Tokenizer

from .bpe import ragged
from .common import bounded_batches, held, id_cuts, order_id, range_number, shuffle_partitions

MAGIC = b"RFIDS001"
BLOCK = 512
#: Characters that the library encodes at once, which bounds what it keeps beside the ids.
AT_ONCE = 1 << 18
#: Before a single blank between words: no tokenizer of the kinds here has a token that crosses the place.
BETWEEN = re.compile(r"(?<=\S)(?= \S)")
#: Distinct pieces that a task remembers, and their characters.
REMEMBERED, PIECE_CHARS = 1_000_000, 1 << 24
HEADER = struct.Struct("<QQQB")


class EliasFano:
    """A sequence of integers that never descends."""

    def __init__(self, low: np.ndarray, high: np.ndarray, size: int, least: int, bits: int):
        self.low, self.high, self.size, self.least, self.bits = low, high, size, least, bits
        ones = np.bitwise_count(high).astype(np.int64)
        whole = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK // 8)) if len(ones) else ones
        self.before = (np.cumsum(whole) - whole).astype(np.uint32)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        size = len(values)
        if not size:
            return cls(np.empty(0, np.uint8), np.empty(0, np.uint8), 0, 0, 0)
        least = int(values[0])
        above = (values - values[0]).view(np.uint64)  # right even where the difference exceeds a signed long
        bits = max(0, (int(above[-1]) // size).bit_length() - 1) if int(above[-1]) else 0
        if bits:
            low = np.packbits(((above[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.empty(0, np.uint8)
        ones = (above >> np.uint64(bits)).astype(np.int64) + np.arange(size)
        unary = np.zeros(-(-(int(ones[-1]) + 1) // 8) * 8, np.uint8)
        unary[ones] = 1
        return cls(low, np.packbits(unary, bitorder="little"), size, least, bits)

    def select(self, i: np.ndarray) -> np.ndarray:
        """Positions of the i-th one bits, from 0."""
        i = np.asarray(i, np.int64)
        block = np.searchsorted(self.before, i, side="right") - 1
        wanted, which = np.unique(block, return_inverse=True)
        span = BLOCK // 8
        padded = np.concatenate([self.high, np.zeros(span, np.uint8)])
        bits = np.unpackbits(padded[wanted[:, None] * span + np.arange(span)], axis=1, bitorder="little")
        upto = np.cumsum(bits, axis=1)
        offsets = np.arange(len(wanted)) * (BLOCK + 1)
        ranks = (upto + offsets[:, None]).ravel()
        at = np.searchsorted(ranks, i - self.before[block].astype(np.int64) + 1 + offsets[which])
        return block * BLOCK + at - which * BLOCK

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.empty(0, np.int64)
        value = (self.select(i) - i).astype(np.uint64) << np.uint64(self.bits)
        if self.bits:
            spots = i[:, None] * self.bits + np.arange(self.bits)
            bits = (self.low[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1
            value |= (bits.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            return (value + np.array(self.least, np.int64).view(np.uint64)).view(np.int64)

    def write(self, to: io.BytesIO) -> None:
        to.write(HEADER.pack(self.size, len(self.low), len(self.high), self.bits) + struct.pack("<q", self.least))
        to.write(self.low.tobytes() + self.high.tobytes())

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        """The sequence at a place of the footer, and the place after it."""
        size, low, high, bits = HEADER.unpack_from(data, at)
        least = struct.unpack_from("<q", data, at + HEADER.size)[0]
        at += HEADER.size + 8
        return cls(np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low), size, least, bits), at + low + high


def open_store(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pa.fs.LocalFileSystem(), path


class ShardWriter:
    """Streams one shard to a hidden name and moves it to its own at the end."""

    def __init__(self, path: str, width: int):
        self.store, self.path = open_store(path)
        self.hidden = f"{self.path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        self.file, self.width = self.store.open_output_stream(self.hidden), width
        self.file.write(MAGIC)
        self.ids, self.sizes, self.nulls = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.nulls += doc_id is None
        self.ids.append(-(1 << 63) if doc_id is None else doc_id)
        self.sizes.append(len(ids))
        self.file.write(ids.astype(f"<u{self.width}").tobytes())

    def close(self) -> tuple[int, int]:
        """Counts of documents and ids."""
        ends = np.cumsum([0, *self.sizes])
        footer = io.BytesIO()
        footer.write(struct.pack("<BQ", self.width, self.nulls))
        EliasFano.of(ends).write(footer)
        EliasFano.of(np.array(self.ids, np.int64)).write(footer)
        self.file.write(footer.getvalue() + struct.pack("<Q", footer.tell()) + MAGIC)
        self.file.close()
        self.store.move(self.hidden, self.path)
        return len(self.ids), int(ends[-1])


class ShardReader:
    """One shard file; only the footer and the ids asked for are read."""

    def __init__(self, path: str):
        store, path = open_store(path)
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} isn't a shard of token ids")
        length = struct.unpack("<Q", tail[:8])[0]
        footer = memoryview(self.file.read_at(length, size - 16 - length))
        self.width, self.nulls = struct.unpack_from("<BQ", footer)
        self.ends, at = EliasFano.read(footer, 9)
        self.doc_ids, _ = EliasFano.read(footer, at)

    def __len__(self) -> int:
        return self.doc_ids.size

    def documents(self, first: int, last: int) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """Ids of documents first .. last - 1, their boundaries in the shard, and their token ids."""
        bounds = self.ends.get(np.arange(first, last + 1))
        names = [None if i < self.nulls else d for i, d in enumerate(self.doc_ids.get(np.arange(first, last)).tolist(), first)]
        data = self.file.read_at(int(bounds[-1] - bounds[0]) * self.width, len(MAGIC) + int(bounds[0]) * self.width)
        return names, bounds, np.frombuffer(data, f"<u{self.width}")


@dataclass(frozen=True)
class Shard:
    path: str
    start: int
    documents: int
    ids: int


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, per_partition: int = 1) -> list[Shard]:
    """Encodes every text by the tokenizers library and writes the shards; returns them in doc_id order with their first global offset.

    A folder without a scheme is taken as Hadoop takes it, in the default file system, by driver and executors alike.

    Texts are shuffled once, by ranges of doc_id; each range is a shard. The list is as
    long as there are ranges: ``per_partition`` for each shuffle partition.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(order_id().alias("_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = id_cuts(rows, "_id", per_partition * shuffle_partitions(spark))
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(made)
    folder = store.makeQualified(made).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer, at, out = library(tokenizer), None, -1, []
        width = 2 if max(own.own.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
        end = np.array([end_id], np.uint32)
        for batch in batches:
            ids, ranges = batch.column("doc_id").to_pylist(), batch.column("_range").to_pylist()
            for doc_id, where, tokens in zip(ids, ranges, encoded(own, batch.column("text")), strict=True):
                if where != at:
                    if writer:
                        out.append((at, writer.path, *writer.close()))
                    writer, at = ShardWriter(f"{folder}/shard-{where:06d}.ids", width), where
                writer.add(doc_id, np.concatenate([tokens, end]))
        if writer:
            out.append((at, writer.path, *writer.close()))
        yield pa.RecordBatch.from_pylist([{"shard": a, "path": p, "documents": d, "ids": i} for a, p, d, i in out], pa.schema([("shard", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    sorted_rows = rows.withColumn("_range", range_number("_id", cuts)).repartition(shuffle_partitions(spark), "_range").sortWithinPartitions("_range", "_id", "text")
    shards, start = [], 0
    for r in sorted(sorted_rows.drop("_id").mapInArrow(run, "shard long, path string, documents long, ids long").collect()):
        shards.append(Shard(f"{folder}/shard-{r.shard:06d}.ids", start, r.documents, r.ids))
        start += r.ids
    return shards


def library(path: str) -> Encoder:
    """The tokenizers library over a file, without truncation and padding."""

    def made() -> Encoder:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        return Encoder(own)

    return held(("library", path), made)


class Encoder:
    """Texts to ids by the library, each distinct piece between words once: pieces go to it in one text, parted by a special token, which it never joins.

    Remembered pieces are forgotten at REMEMBERED of them or PIECE_CHARS characters. A vocabulary without special tokens, and texts that have
    the parting one, go to the library piece by piece.
    """

    def __init__(self, own: Tokenizer):
        self.own = own
        special = [(i, t.content) for i, t in sorted(own.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.normalized or t.single_word)]
        self.part_id, self.part = special[0] if special else (None, None)
        #: Whether white space gives no ids, so that every blank parts pieces.
        self.dropped = self.ids(" a") == self.ids("a") and not self.ids("  ")
        self.forget()

    def ids(self, text: str) -> list[int]:
        return self.own.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.at, self.sizes, self.used, self.chars = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), 0, 0

    def pieces(self, text: str) -> list[str]:
        return text.split(" ") if self.dropped else BETWEEN.split(text)

    def learn(self, new: list[str]) -> None:
        """Adds the ids of pieces that aren't known; in the pool the parting ones stay between them."""
        plain = [p for p in new if self.part is not None and self.part not in p]
        odd = [p for p in new if self.part is None or self.part in p]
        lists = [self.own.encode_batch_fast([self.part.join(plain)], add_special_tokens=False)[0].ids] if plain else []
        found = [np.array(x, np.uint32) for x in [*lists, *map(self.ids, odd)]]
        parts = np.flatnonzero(found[0] == self.part_id) if plain else np.empty(0, np.int64)
        ends = np.cumsum([len(x) for x in found])
        begins = np.concatenate([[0], ends[:-1]])
        if plain:
            begins, ends = np.concatenate([[0], parts + 1, begins[1:]]), np.concatenate([parts, ends])
        known = len(self.known)
        self.known.update(zip([*plain, *odd], range(known, known + len(ends)), strict=True))
        self.at = extended(self.at, known, self.used + begins)
        self.sizes = extended(self.sizes, known, ends - begins)
        self.pool = extended(self.pool, self.used, np.concatenate(found))
        self.used += int(sum(map(len, found)))
        self.chars += sum(map(len, new))

    def some(self, texts: list[str]) -> list[np.ndarray]:
        lists = [self.pieces(t) for t in texts]
        each = set(chain.from_iterable(lists))
        new = list(each.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED or self.chars > PIECE_CHARS:
            self.forget()
            new = list(each)
        if new:
            self.learn(new)
        counts = [len(x) for x in lists]
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(lists)), np.int64, sum(counts))
        sizes = self.sizes[which]
        ids = self.pool[ragged(self.at[which], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *counts])].tolist()
        return [ids[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)]


def extended(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """The array with more after its first elements, in twice the room where there is too little."""
    if used + len(more) > len(array):
        array = np.concatenate([array[:used], np.empty(max(used, len(more)), array.dtype)])
    array[used : used + len(more)] = more
    return array


def encoded(own: Encoder, texts: pa.Array) -> Iterator[np.ndarray]:
    """Ids of the texts, some characters' worth at a time."""
    some, size = [], 0
    for value in texts:
        some.append(value.as_py() or "")
        size += len(some[-1])
        if size >= AT_ONCE:
            yield from own.some(some)
            some, size = [], 0
    if some:
        yield from own.some(some)


def read(spark: SparkSession, shards: list[Shard], at_once: int = 1 << 20) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, read back from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard, first = ShardReader(path), 0
                per_document = max(1, int(shard.ends.get(np.array([len(shard)]))[0]) // max(1, len(shard)))
                while first < len(shard):
                    last = min(len(shard), first + max(1, at_once // per_document))
                    names, bounds, ids = shard.documents(first, last)
                    inside = (bounds - bounds[0]).tolist()
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(inside[:-1], inside[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start + bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    first = last

    table = spark.createDataFrame([(s.path, s.start) for s in shards], "path string, start long")
    return table.repartition(max(1, len(shards))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
