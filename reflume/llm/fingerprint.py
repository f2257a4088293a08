"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text. A chunk ends where the hash has enough
zero bits; before the normal size it needs more of them and after it fewer, so sizes stay
close to normal. Boundaries depend on nearby bytes only: an insertion moves the chunks
behind it but does not change them. A text's fingerprint is the set of its chunks'
digests, each weighted by the bytes it covers, and the containment of one text in another
is the share of its weight whose digests the other has.

Nulls and empty texts have the empty fingerprint. Two empty fingerprints are alike (1.0);
an empty and a non-empty one are not (0.0). Repeated rows are fingerprinted like others. Rows of
one doc_id follow each other in the order of their texts, and null ids come after all others, as one id.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, id_cuts, mix64, order_id, powers, random_words, range_number, shuffle_partitions

LEAST, NORMAL, MOST = 8, 40, 128
#: Zero bits asked for before and after the normal size.
STRICT_BITS, LOOSE_BITS = 7, 3
DIGEST_BYTES, WEIGHT_BYTES = 5, 4
RECORD = np.dtype([("digest", f"V{DIGEST_BYTES}"), ("weight", "<u4")])

_GEAR = random_words(11, 256, np.uint32)
_BYTE = random_words(12, 256)
_POWER = powers(0x9E3779B97F4A7C15, MOST)
_STRICT = np.uint32(((1 << STRICT_BITS) - 1) << (32 - STRICT_BITS))
_LOOSE = np.uint32(((1 << LOOSE_BITS) - 1) << (32 - LOOSE_BITS))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte; it remembers 32 bytes. Built by doubling the window."""
    h = _GEAR[data]
    for span in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[span:] += h[:-span] << np.uint32(span)
        h = wider
    return h


def boundaries(data: np.ndarray) -> list[int]:
    """Starts of the chunks."""
    size = len(data)
    if size <= LEAST:
        return [0]
    h = gear_hashes(data)
    loose_at = np.flatnonzero((h & _LOOSE) == 0)
    strict = loose_at[(h[loose_at] & _STRICT) == 0].tolist()
    loose = loose_at.tolist()
    strict.append(size + MOST)
    loose.append(size + MOST)
    starts, start, i, j = [], 0, 0, 0
    while start < size:
        starts.append(start)
        i = bisect_left(strict, start + LEAST - 1, i)
        if strict[i] < start + NORMAL:
            start = strict[i] + 1
            continue
        j = bisect_left(loose, start + NORMAL - 1, j)
        start = min(loose[j] + 1, start + MOST)
    return starts


def chunk_weights(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct chunk digests and the bytes that each covers."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data = np.frombuffer(text, np.uint8)
    starts = np.array(boundaries(data))
    sizes = np.diff(starts, append=len(data))
    within = np.arange(len(data)) - np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_BYTE[data] * _POWER[within], starts)
        digests = mix64(sums + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    digests >>= np.uint64(64 - 8 * DIGEST_BYTES)
    order = np.argsort(digests, kind="stable")
    digests, sizes = digests[order], sizes[order]
    first = np.flatnonzero(np.diff(digests, prepend=~digests[:1]))
    return digests[first], np.add.reduceat(sizes, first)


def containment(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of a's weight that b has too."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    shared = np.where(b[0][at] == a[0], np.minimum(a[1], b[1][at]), 0)
    return float(shared.sum() / a[1].sum())


def pack(weights: tuple[np.ndarray, np.ndarray]) -> str:
    """Base64 of (digest, weight) records in the order of digests."""
    records = np.empty(len(weights[0]), RECORD)
    wide = weights[0].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGEST_BYTES :]
    records["digest"] = np.ascontiguousarray(wide).view(f"V{DIGEST_BYTES}").ravel()
    records["weight"] = weights[1]
    return base64.b64encode(records.tobytes()).decode()


def unpack(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """What pack() packed."""
    records = np.frombuffer(base64.b64decode(fingerprint), RECORD)
    wide = np.zeros((len(records), 8), np.uint8)
    wide[:, 8 - DIGEST_BYTES :] = np.frombuffer(records["digest"].tobytes(), np.uint8).reshape(-1, DIGEST_BYTES)
    return wide.view(">u8").ravel().astype(np.uint64), records["weight"].astype(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of every text, without a shuffle."""

    @F.pandas_udf(T.StringType())
    def of(texts):
        return texts.map(lambda t: pack(chunk_weights((t or "").encode())))

    return docs.withColumn(out, of(F.col(text)))


def beside_next(docs: DataFrame, per_partition: int = 4) -> DataFrame:
    """Deals (doc_id, text) out by ranges of doc_id so that each row has its successor in its own range.

    The order is by descending doc_id, then text; null ids come last. Quantiles of doc_id
    bound the ranges (``per_partition`` of them for each shuffle partition). The first row
    of a range goes to the range before it too, marked ``guest``; that of the whole
    order goes to the last range. Texts are shuffled once. Only one id for each range
    reaches the driver. Partitions come sorted: within a range by rank, guests at its end.
    """
    bounded_batches(docs.sparkSession)
    spark, n = docs.sparkSession, per_partition * shuffle_partitions(docs.sparkSession)
    rows = docs.select(order_id().alias("_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = id_cuts(rows, "_id", n)
    # Ranges are numbered from the largest ids down.
    rows = rows.withColumn("_range", F.lit(len(cuts)) - range_number("_id", cuts))
    heads = sorted((r["_range"], r["head"]) for r in rows.groupBy("_range").agg(F.max("_id").alias("head")).collect())
    guests = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    table = spark.createDataFrame(guests, "_id long, _to int")
    both = rows.join(F.broadcast(table), "_id", "left").select(
        "doc_id", "text", "_id", F.explode(F.expr("if(_to is null, array(named_struct('r', _range, 'g', false)), array(named_struct('r', _range, 'g', false), named_struct('r', _to, 'g', true)))")).alias("p")
    )
    both = both.select("doc_id", "text", "_id", F.col("p.r").alias("_range"), F.col("p.g").alias("guest"))
    return both.repartition(shuffle_partitions(spark), "_range").sortWithinPartitions("_range", "guest", F.desc("_id"), "text").drop("_id")


def edited_text(text: str, following: str) -> str:
    """The last third replaced by as many characters from the start of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


NEIGHBOUR_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbour_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness to it and to the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        pending = None  # (range, doc_id, text, weights)
        for batch in batches:
            out = []
            for doc_id, text, where, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_range", "guest")), strict=True):
                text = text or ""
                if guest and (pending is None or pending[0] != where):
                    continue  # another row of the guest's id came first
                weights = chunk_weights(text.encode())
                if pending is not None:
                    _, own_id, own, own_weights = pending
                    edited = edited_text(own, text).encode()
                    changed = chunk_weights(edited)
                    out.append((own_id, len(own), hashlib.sha256(edited).hexdigest(), pack(own_weights), pack(changed), containment(own_weights, changed), containment(own_weights, weights)))
                pending = None if guest else (where, doc_id, text, weights)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return beside_next(docs).mapInArrow(run, NEIGHBOUR_SCHEMA)
