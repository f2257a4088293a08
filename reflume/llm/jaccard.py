"""N-gram Jaccard join by parity sketches: every group of documents connected by links.

Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of word k-gram
hashes. Sizes then differ by that ratio at most, and the symmetric difference is at most
(100 - percent) / (100 + percent) of the sizes' sum.

A band's sketch has M segments. A token belongs to one segment by its hash and is XORed
into it, so tokens that both documents have cancel out, and the number of segments that
differ is at most the symmetric difference D. With M > D, some segment is equal: documents
are joined on equal segments, within bands of the smaller one's size. A segment without
tokens says little; it is a key only for documents with so many of them that all equal
segments might be empty ones. As all but D of a document's segments with tokens are keys of the other
one too, it leaves out one less of its keys, those that most documents have, so passages that many
documents share are seldom keys. A second
sketch of parity bits has one bit flipped by each token; its Hamming distance is at
most the symmetric difference too and drops most pairs before their sets are compared.

Links are only looked for as far as the components need them, which loses none between
components: first each document against the first and the previous one of its key; then,
in keys whose documents aren't all connected, against the one with most links; last all
pairs of a key that are in different components and pass the sketches, each at the keys
that come with none that both have among the BEFORE keys before, the first one always.
Exact copies share a set and are one node throughout.

Words are what stands between ASCII white space, with A-Z lower-cased. Fewer words than k
are one k-gram; no words or a null text make an empty set, which links with nothing: the
component is the document's own id. Repeated rows get a row each. A component's id is
the smallest doc_id in it; null ids are null only where nothing else is in the component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, drop_stage, materialize, mix64, powers, random_words, screened

#: Where no contract says otherwise: words of a shingle and percent of similarity.
WORDS, PERCENT = 5, 80
BITS = 512
#: Links that a single task may unite: 16 MB of ids, some 100 MB at work.
ONE_TASK = 1_000_000
#: Keys before its own that a row of an unfinished key remembers.
BEFORE = 16
_LANES = BITS // 64

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = random_words(31, 256)


@lru_cache(1)
def _short_powers() -> np.ndarray:
    return powers(0xD1342543DE82EF95, 4096)


@lru_cache(4)
def _places(words: int) -> np.ndarray:
    return random_words(32, words)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word k-grams."""
    data = np.frombuffer((text or "").encode().translate(_LOWER), np.uint8)
    blank = _SPACE[data]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64)
    data, blank = data[starts[0] :], blank[starts[0] :]
    starts = starts - starts[0]
    sizes = np.diff(starts, append=len(data))
    longest = int(sizes.max())
    power = _short_powers() if longest <= 4096 else powers(0xD1342543DE82EF95, longest)
    with np.errstate(over="ignore"):
        values = _BYTE[data] * power[np.arange(len(data)) - np.repeat(starts, sizes)]
        values[blank] = 0
        hashes = mix64(np.add.reduceat(values, starts))
        places, n = _places(words), len(hashes) - words + 1
        if n < 1:
            return mix64((hashes * places[: len(hashes)]).sum(keepdims=True) + np.uint64(len(hashes)))
        total = hashes[:n] * places[0]
        for i in range(1, words):
            total += hashes[i : n + i] * places[i]
    return np.unique(mix64(total))


def most_apart(total: int, percent: int) -> int:
    """The largest symmetric difference of two linked sets whose sizes sum up to total."""
    return (100 - percent) * total // (100 + percent)


@lru_cache(4096)
def bands(size: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(band, most that differ, segments) for each band that a set of this size has a sketch in.

    A band is for the pairs whose smaller set has from low to high - 1 tokens; high is a ratio of
    100 / percent above low, so that a set is in two bands at most.
    """
    found, band, low = [], 0, 1
    while low <= size:
        high = max(low + 1, 100 * low // percent, 9 * low // 8)
        largest = 100 * (high - 1) // percent
        if size <= largest:
            apart = most_apart(high - 1 + largest, percent)
            found.append((band, apart, apart + 1 + (max(1, apart // 8) if apart else 0)))
        band, low = band + 1, high
    return tuple(found)


def segment_keys(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """Keys of the set's segments in all its bands, and by band % 4, the keys' low bits, how many a pair has in common to spare."""
    keys, spare = [], [0] * 4
    top = tokens >> np.uint64(32)
    for band, apart, segments in bands(len(tokens), percent):
        where = (top * np.uint64(segments)) >> np.uint64(32)  # ascends with the token
        starts = np.flatnonzero(np.diff(where, prepend=where[:1] + np.uint64(1)))
        place = np.uint64(band << 40) + where[starts]
        spare[band % 4] = max(0, len(starts) - apart - 1)  # the other set may have no keys of empty segments
        with np.errstate(over="ignore"):
            found = [mix64(np.bitwise_xor.reduceat(tokens, starts) + mix64(place + np.uint64(1)))]
            if len(starts) <= apart:
                empty = np.setdiff1d(np.arange(segments, dtype=np.uint64), where[starts])
                found.append(mix64(mix64(np.uint64(band << 40) + empty + np.uint64(1))))
            keys += [k >> np.uint64(2) << np.uint64(2) | np.uint64(band % 4) for k in found]
    return np.concatenate(keys), spare


def parity(tokens: np.ndarray) -> np.ndarray:
    """BITS bits, each flipped by the tokens that hash to it."""
    odd = np.bincount((tokens % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_parity(tokens: np.ndarray) -> bytes:
    """Parity bits as in parity(), at least two for each token, so that sets of any size are told apart."""
    bits = max(BITS, 1 << (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """Hamming distance of two wide sketches; the longer one is folded, which keeps it a parity sketch."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def row_key(text: Column) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(text.cast("string"))


def sketched(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, row_key (the text's hash), n_shingles, node (the set's hash, null if empty), and the sketches of the first row of each set in a task."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("parity", pa.list_(pa.int64())), ("spare", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                tokens = shingles(text.as_py(), words)
                if not len(tokens):
                    rows.append((0, None, None, None, None))
                    continue
                with np.errstate(over="ignore"):
                    node = int(mix64(mix64(tokens + np.uint64(1)).sum(keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0])
                fresh = node not in seen
                seen.add(node)
                keys, spare = segment_keys(tokens, percent) if fresh else (None, None)
                rows.append((len(tokens), node, parity(tokens) if fresh else None, spare, keys.view(np.int64) if fresh else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:], strict=True))], schema=schema)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("text")).alias("row_key"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, row_key long, n_shingles long, node long, parity array<long>, spare array<int>, keys array<long>")


def token_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, its set's hashes and wide sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets, wide = [], [], []
            for text in batch.column("text"):
                tokens = shingles(text.as_py(), words)
                if len(tokens):
                    with np.errstate(over="ignore"):
                        nodes.append(int(mix64(mix64(tokens + np.uint64(1)).sum(keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0]))
                    sets.append(tokens.view(np.int64))
                    wide.append(wide_parity(tokens))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(wide, pa.binary())], names=["node", "tokens", "wide"])

    return docs.select("text").mapInArrow(run, "node long, tokens array<long>, wide binary")


def near_by_sketch(a: str, b: str, percent: int) -> Column:
    """Sizes and parity sketches allow a link between the rows of these aliases."""
    sizes = F.col(f"{a}.n") + F.col(f"{b}.n")
    distance = sum((F.bit_count(F.col(f"{a}.parity")[i].bitwiseXOR(F.col(f"{b}.parity")[i])) for i in range(1, _LANES)), F.bit_count(F.col(f"{a}.parity")[0].bitwiseXOR(F.col(f"{b}.parity")[0])))
    fits = 100 * F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) >= percent * F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n"))
    return fits & (distance * (100 + percent) <= (100 - percent) * sizes)


def sets_of(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node and tokens of the given nodes (node, sample), from the texts of their samples."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = screened(rows, "doc_id", nodes.select("sample")).where("_maybe")
    return token_sets(texts, words).join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: whole sets are compared for those that both sketches let through.

    The sketch of BITS bits is narrow and drops what it can first; the wide one, a thirtieth of a set, is as
    sharp for large sets, so that few sets move that don't link.
    """
    sizes = nodes.select("node", "n", "parity")
    near = pairs.join(sizes.alias("x"), F.col("a") == F.col("x.node")).join(sizes.alias("y"), F.col("b") == F.col("y.node")).where(near_by_sketch("x", "y", percent))
    near = near.select("a", "b", ((100 - percent) * (F.col("x.n") + F.col("y.n")) / (100 + percent)).alias("most"))
    wide = sets.select("node", "wide")
    beside = near.join(wide.withColumnRenamed("wide", "x"), F.col("a") == F.col("node")).drop("node").join(wide.withColumnRenamed("wide", "y"), F.col("b") == F.col("node")).drop("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [least_apart(x, y) <= most for x, y, most in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "most")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(fits, pa.bool_()))

    few = materialize(beside.mapInArrow(run, "a long, b long"), "near")
    whole = sets.select("node", "tokens")
    both = few.join(whole.alias("x"), F.col("a") == F.col("x.node")).join(whole.alias("y"), F.col("b") == F.col("y.node"))
    shared = F.size(F.array_intersect("x.tokens", "y.tokens"))
    union = F.size("x.tokens") + F.size("y.tokens") - shared
    links = materialize(both.where(100 * shared >= percent * union).select("a", "b"), "links")
    drop_stage(few)
    return links


def united(edges: DataFrame) -> DataFrame:
    """components() of edges that fit one task: roots hook on to smaller ones, and all nodes point at their roots, until no edge is between two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        ends = [np.concatenate([none, *c]) for c in zip(*((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches), strict=True)] or [none, none]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        a, b = np.split(at, 2)
        root = np.arange(len(nodes))
        while len(a):
            x, y = root[a], root[b]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root = up
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[root], pa.int64())], names=["node", "label"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, label long")


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node and label, the smallest node of its component, for all nodes of the links (a, b), which are written already.

    Up to ``one_task`` counted links are united in a single task. More are first contracted
    by large and small stars in turn, until the edges stay as they are; each round's edges are
    written, so nothing of a lost executor has to be computed again from the start.
    """
    if links.count() <= one_task:
        return materialize(united(links), "labels")
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b").distinct())
        before = mark
        around = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        contracted = materialize(small.where("a != b").distinct(), "edges")
        drop_stage(edges)
        edges = contracted


def unfinished(wide: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, node, label) of the keys whose nodes are in several components."""
    rows = wide.select("key", "node").distinct().join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    several = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    return rows.join(several, "key", "left_semi")


def rare_keys(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows (key, node) of keys with several rows, without those that each node can spare in each band.

    The rarest key that two linked nodes have in common has all others of theirs before it in the
    order of descending frequency, so leaving out as many less one as they have at least loses no pair.
    """
    often = keyed.select("key", "node", F.count("*").over(Window.partitionBy("key")).alias("often")).where("often > 1")
    low = F.expr("cast(key & 3 as int)")
    placed = often.join(nodes.select("node", "spare"), "node").select("key", "node", low.alias("low"), F.col("spare")[low].alias("spare"), "often")
    place = F.dense_rank().over(Window.partitionBy("node", "low").orderBy(F.desc("often"), "key"))
    return placed.select("key", "node", "spare", place.alias("place")).where("place > spare").select("key", "node")


def link_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs."""
    return linked(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def linked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """link_components() with row_key and component, a label that no other component has, of each row.

    A row without doc_id has its component's smallest id, or null where no row of it has one, or where it has no words. Rows without words have
    their own id and no component.
    """
    bounded_batches(docs.sparkSession)
    made = materialize(sketched(docs, words, percent), "sketches")
    narrow = materialize(made.select("doc_id", "row_key", "n_shingles", "node"), "sets")
    nodes = materialize(made.where("node is not null").groupBy("node").agg(F.max("n_shingles").alias("n"), F.min("doc_id").alias("sample"), F.first("parity", True).alias("parity"), F.first("spare", True).alias("spare")), "nodes")

    order = Window.partitionBy("key").orderBy("node")
    rank = F.row_number().over(order)
    after = [F.lead("node", i).over(order) for i in (1, 2, 3)]
    wide = (rank >= 4) | F.when(rank == 1, after[2].isNotNull()).when(rank == 2, after[1].isNotNull()).otherwise(after[0].isNotNull())
    keyed = rare_keys(made.select("node", F.explode("keys").alias("key")), nodes)
    shared = keyed.select("key", "node", F.first("node").over(order).alias("head"), F.lag("node").over(order).alias("prior"), after[0].alias("next"), wide.alias("wide"))
    shared = materialize(shared.where("head != node or next != node").drop("next"), "shared")
    drop_stage(made)
    sets = materialize(sets_of(shared.select("node").distinct().join(nodes, "node"), docs, words), "tokens")

    pairs = shared.select(F.explode(F.array(F.struct(F.col("head").alias("a"), F.col("node").alias("b")), F.struct(F.col("prior").alias("a"), F.col("node").alias("b")))).alias("p")).select("p.a", "p.b")
    links = verified(pairs.where("a != b").distinct(), nodes, sets, percent)
    labels = components(links)

    rows = materialize(unfinished(shared.where("wide"), labels), "unfinished")
    drop_stage(shared)
    if not rows.isEmpty():
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        centre = rows.join(degree, "node", "left").groupBy("key").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "node", "label")).alias("c"))
        pairs = rows.join(centre, "key").where("label != c.label").select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()
        links = links.union(verified(pairs, nodes, sets, percent))
        labels = components(links)
        rows = unfinished(rows, labels)
        before = F.collect_list("key").over(Window.partitionBy("node").orderBy("key").rowsBetween(-BEFORE, -1))
        rows = materialize(rows.withColumn("before", before).join(nodes.select("node", "n", "parity"), "node"), "unfinished")
        fresh = ~F.arrays_overlap("x.before", "y.before")
        apart = rows.alias("x").join(rows.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")) & near_by_sketch("x", "y", percent) & fresh)
        links = links.union(verified(apart.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), nodes, sets, percent))
        labels = components(links)

    placed = nodes.select("node", "sample").join(labels, "node", "left").select("node", "sample", F.coalesce("label", "node").alias("label"))
    least = placed.groupBy("label").agg(F.min("sample").alias("component_id"))
    of = placed.join(least, "label").select("node", "component_id", F.col("label").alias("component"))
    out = narrow.join(of, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "row_key", "n_shingles", own.alias("component_id"), "component")


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, that of its smallest doc_id; documents without words or without doc_id all stay.

    Of several rows with that id, the one whose text has the smallest hash stays, and of those with its text the one that is first
    as JSON. Rows of one doc_id with texts in other components go or stay by those.
    """
    found = materialize(linked(docs, words, percent).select("doc_id", "row_key", "component_id", "component").where("doc_id is not null and component is not null"), "linked")
    again = materialize(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    repeated = found.join(again.withColumnRenamed("doc_id", "_of"), F.col("doc_id") == F.col("_of")).where("doc_id = component_id")
    first = repeated.groupBy("doc_id", "component").agg(F.min("row_key").alias("first"))
    others = repeated.join(first, ["doc_id", "component"]).where("row_key != first").select("doc_id", "row_key")
    gone = materialize(found.where("doc_id != component_id").select("doc_id", "row_key").union(others).distinct().toDF("_gone", "_gone_key"), "gone")
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").cast("long").alias("_of"), row_key(F.col("text")).alias("_key"))
    rows = screened(packed, "_of", gone.select("_gone").union(again))
    wordless = F.coalesce(F.btrim(F.col("_doc.text").cast("string"), F.lit(" \t\n\x0b\x0c\r")), F.lit("")) == ""
    sure = ~F.col("_maybe") | F.col("_of").isNull() | wordless
    maybe = rows.where(~sure).join(gone, (F.col("_of") == F.col("_gone")) & (F.col("_key") == F.col("_gone_key")), "left_anti")
    one = maybe.groupBy("_of", "_key").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc"))
    return rows.where(sure).select("_doc").union(one.select("_doc")).select("_doc.*")
