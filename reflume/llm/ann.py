"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

Equal vectors are one node. Each node starts with the nearest of those that lie beside it
along a few random directions. Then neighbours of neighbours are joined: at every node, its
neighbours and the nodes that have it for a neighbour meet, and each pair with a new edge that is nearer
than what either has is proposed to it; that is done once and repeated until the lists of SAMPLE nodes, whose true ones are found by one pass over
all vectors, hold ENOUGH of them, or few lists change: a wide beam makes up for lists that lack some. The lists, with
their vectors, are dealt to buckets once, where the queries' hops meet them. A query starts at its own node and expands the nearest nodes
of its beam, which is wider for more nodes, until all of them are expanded; what the beam holds at the end is measured
exactly, in double precision on the original vectors.

The index holds every row that takes part. Vectors that are null, zero, hold null or
non-finite components, or aren't as long as most of the table's vectors take no part.
Ties in the exact measure go to the smaller vec_id. Null ids are no queries and no candidates. Repeated
rows count once. An id with several vectors is as near as the nearest of them, as a query and as a candidate, and a
query excludes all rows of its own id.

Reverse neighbours of a node are limited to its K nearest, as the graph's own lists are;
that bounds the work at a node that very many have for a neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucketed, drop_stage, materialize, shuffle_partitions

#: Neighbours of a node, random directions, nodes that are compared along them at once.
K, DIRECTIONS, BLOCK = 24, 3, 2048
#: Joins end when so many of the true neighbours of so many nodes are found, or a lesser share of the edges is new and nearer by more than half precision tells apart.
SAMPLE, ENOUGH, FEW, NEARER = 64, 1 / 3, 0.02, 1e-3
#: A query's beam for so many nodes; it grows with the square root of their count.
BEAM, BEAM_NODES = 320, 50_000
#: Queries: ids that this divides; neighbours returned.
EVERY, NEAREST = 50, 5

EDGES = pa.schema([("v", pa.int64()), ("u", pa.int64()), ("s", pa.float32())])


def taking_part(table: DataFrame) -> DataFrame:
    """vec_id, x (doubles) and its size, of the rows whose vectors are fit to be measured."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    nonzero = F.exists("x", lambda c: F.coalesce(c != 0, F.lit(False)))
    return rows.where(F.coalesce(finite, F.lit(False)) & nonzero).withColumn("size", F.size("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of half-precision components from binaries of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), -1).astype(np.float32)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, which arrive one key after another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def table_column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def edge_batch(v: list[np.ndarray], u: list[np.ndarray], s: list[np.ndarray]) -> pa.RecordBatch:
    ints, floats = np.empty(0, np.int64), np.empty(0, np.float32)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ints, *v])), pa.array(np.concatenate([ints, *u])), pa.array(np.concatenate([floats, *s]).astype(np.float32))], schema=EDGES)


def nodes_of(rows: DataFrame) -> DataFrame:
    """node, x, and members: the NEAREST + 1 smallest vec_ids of the rows with this vector, all that any result can hold of them."""
    keyed = rows.withColumn("node", F.xxhash64("x"))
    order = Window.partitionBy("node").orderBy("vec_id")
    few = keyed.select("node", "vec_id").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= NEAREST + 1)
    members = few.groupBy("node").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    return keyed.groupBy("node").agg(F.first("x").alias("x")).join(members, "node")


def halved(nodes: DataFrame) -> DataFrame:
    """node and vec: the unit vector in half precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("x").flatten()).reshape(batch.num_rows, -1)
            x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
            unit = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in unit], pa.binary())], names=["node", "vec"])

    return nodes.select("node", "x").mapInArrow(run, "node long, vec binary")


def beside(vectors: DataFrame, count: int, size: int) -> DataFrame:
    """Edges to the nearest K of BLOCK nodes that follow each other along each random direction."""
    found = None
    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(DIRECTIONS):
        direction = rng.standard_normal(size).astype(np.float32)

        def project(batches: Iterator[pa.RecordBatch], direction: np.ndarray = direction) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(matrix(batch.column("vec")) @ direction, pa.float32())], names=["node", "vec", "at"])

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def compared() -> pa.RecordBatch:
                block = pa.Table.from_batches(held)
                ids, x = table_column(block, "node").to_numpy(), matrix(table_column(block, "vec"))
                sims = x @ x.T
                np.fill_diagonal(sims, -2)
                few = min(K, len(ids) - 1)
                if few < 1:
                    return edge_batch([], [], [])
                top = np.argpartition(-sims, few - 1, axis=1)[:, :few]
                return edge_batch([np.repeat(ids, few)], [ids[top].ravel()], [np.take_along_axis(sims, top, 1).ravel()])

            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    room = BLOCK - sum(b.num_rows for b in held)
                    held.append(batch.slice(at, room))
                    at += room
                    if sum(b.num_rows for b in held) >= BLOCK:
                        yield compared()
                        held.clear()
            if held:
                yield compared()

        dealt = vectors.mapInArrow(project, "node long, vec binary, at float").repartitionByRange(max(1, count // (4 * BLOCK)), "at", "node").sortWithinPartitions("at", "node")
        edges = dealt.mapInArrow(nearest, "v long, u long, s float")
        found = edges if found is None else found.union(edges)
    return found


def top_edges(v: np.ndarray, u: np.ndarray, s: np.ndarray, old: np.ndarray) -> list[np.ndarray]:
    """v, u, s, fresh and new of the K nearest distinct u of each v; rows come by v, nearest first, and old tells those of the graph."""
    again = np.lexsort((np.arange(len(v)), u, v))
    first = np.ones(len(v), bool)
    first[1:] = (v[again][1:] != v[again][:-1]) | (u[again][1:] != u[again][:-1])
    group = np.cumsum(first) - 1
    known = np.zeros(group[-1] + 1 if len(v) else 0, bool)
    np.logical_or.at(known, group, old[again])
    kept = np.sort(again[first])
    was = np.empty(len(v), bool)
    was[again] = known[group]
    begins = np.flatnonzero(np.diff(v, prepend=v[:1] + 1)) if len(v) else np.empty(0, np.int64)
    of = np.searchsorted(begins, np.arange(len(v)), side="right") - 1
    counts, last = np.bincount(of[old], minlength=len(begins)), np.full(len(begins), 2.0)
    np.minimum.at(last, of[old], s[old])
    least = np.where(counts >= K, last + NEARER, -2.0)
    place = np.arange(len(kept)) - np.searchsorted(of[kept], of[kept], side="left")
    kept = kept[place < K]
    return [v[kept], u[kept], s[kept], ~was[kept] & (s[kept] > least[of[kept]]), ~was[kept]]


def best(edges: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """The K nearest distinct u of each v in edges and graph; new tells those that the graph lacks, fresh those of them that are nearer than its last of v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def made(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
            whole = [np.concatenate([np.empty(0, t), *c]) for c, t in zip(zip(*columns, strict=True) if columns else [[]] * 4, (np.int64, np.int64, np.float32, bool), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in top_edges(*whole)], names=["v", "u", "s", "fresh", "new"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cut = int(np.searchsorted(columns[0], columns[0][-1], side="left"))  # the last node's rows may go on
            if cut or held and held[0][0][-1] != columns[0][0]:
                yield made([*held, [c[:cut] for c in columns]])
                held = []
            held.append([c[cut:] for c in columns])
        if held:
            yield made(held)

    every = edges.select("v", "u", "s", F.lit(False).alias("old"))
    if graph is not None:
        every = every.union(graph.select("v", "u", "s", F.lit(True)))
    return every.repartition(shuffle_partitions(edges.sparkSession), "v").sortWithinPartitions("v", F.desc("s"), "u").mapInArrow(run, "v long, u long, s float, fresh boolean, new boolean")


def joined(graph: DataFrame, vectors: DataFrame) -> DataFrame:
    """Neighbours of neighbours: at each hub, the pairs of nodes that have it or that it has, one of them by a new edge, where nearer than their lists' last.

    Hubs without a new edge have been joined already and are passed over.
    """
    reverse = graph.select(F.col("u").alias("hub"), F.col("v").alias("node"), "new", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v")).alias("n")).where(F.col("n") <= K)
    both = graph.select(F.col("v").alias("hub"), F.col("u").alias("node"), "new").union(reverse.select("hub", "node", "new"))
    hubs = both.union(vectors.select("node", "node", F.lit(False))).groupBy("hub", "node").agg(F.max("new").alias("new"))
    last = graph.groupBy("v").agg(F.when(F.count("*") >= K, F.min("s")).otherwise(-2.0).cast("float").alias("last"))
    known = vectors.join(last, F.col("node") == F.col("v"), "left").select("node", "vec", F.coalesce("last", F.lit(-2.0).cast("float")).alias("last"))
    met = hubs.join(known, "node").repartition(shuffle_partitions(graph.sparkSession), "hub").sortWithinPartitions("hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, u, s, held = [], [], [], 0
        for group in runs(batches, "hub"):
            new = table_column(group, "new").to_numpy(zero_copy_only=False)
            if not new.any():
                continue
            ids, x, last_of = table_column(group, "node").to_numpy(), matrix(table_column(group, "vec")), table_column(group, "last").to_numpy()
            sims = x @ x.T
            np.fill_diagonal(sims, -3)
            a, b = np.nonzero((sims > last_of[:, None]) & (new[:, None] | new))
            v.append(ids[a])
            u.append(ids[b])
            s.append(sims[a, b])
            held += len(a)
            if held > 1 << 16:
                yield edge_batch(v, u, s)
                v, u, s, held = [], [], [], 0
        yield edge_batch(v, u, s)

    return met.select("hub", "node", "vec", "last", "new").mapInArrow(run, "v long, u long, s float")


def farthest(vectors: DataFrame) -> DataFrame:
    """v and last of SAMPLE nodes: how near the last of its true K neighbours is, by one pass over all vectors. Only the sample's vectors reach the driver."""
    some = vectors.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
    ids = np.array([r["node"] for r in some], np.int64)
    asked = np.frombuffer(b"".join(bytes(r["vec"]) for r in some), np.float16).reshape(len(some), -1).astype(np.float32) if some else np.empty((0, 1), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), K), -2, np.float32)
        for batch in batches:
            if batch.num_rows and len(ids):
                sims = asked @ matrix(batch.column("vec")).T
                sims[ids[:, None] == batch.column("node").to_numpy()] = -2
                best = -np.sort(-np.concatenate([best, sims], axis=1), axis=1)[:, :K]
        row, _ = np.nonzero(best > -2)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best[best > -2], pa.float32())], names=["v", "s"])

    near = Window.partitionBy("v").orderBy(F.desc("s"))
    top = vectors.mapInArrow(run, "v long, s float").withColumn("n", F.row_number().over(near)).where(F.col("n") <= K)
    return top.groupBy("v").agg(F.min("s").alias("last"), F.count("*").alias("k"))


def graph_of(vectors: DataFrame, count: int, size: int) -> DataFrame:
    """Edges (v, u, s) of the neighbour graph, joined once and until ENOUGH of the sample's true edges are found or less than FEW are fresh."""
    graph = materialize(best(beside(vectors, count, size)), "graph")
    true = vectors.sparkSession.createDataFrame(farthest(vectors).collect(), "v long, last float, k long")  # SAMPLE rows
    wanted = true.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()["k"]

    def enough() -> bool:
        found = graph.join(F.broadcast(true), "v").agg(F.count_if(F.col("s") >= F.col("last") - NEARER / 10).alias("n")).first()["n"]
        return found >= ENOUGH * wanted

    while True:
        after = materialize(best(joined(graph, vectors), graph), "graph")
        drop_stage(graph)
        graph = after
        changed = graph.agg(F.count_if("fresh").alias("fresh"), F.count("*").alias("n")).first()
        if changed["fresh"] <= FEW * changed["n"] or enough():
            return graph.select("v", "u", "s")


def beam_of(count: int) -> int:
    """The width of a query's beam among so many nodes."""
    return max(BEAM, math.ceil(BEAM * math.sqrt(count / BEAM_NODES)))


def lists_of(graph: DataFrame, vectors: DataFrame) -> DataFrame:
    """node, its neighbours, and their vectors in one binary."""
    each = graph.join(vectors.withColumnRenamed("node", "u"), "u").select("v", "u", "vec")
    dealt = each.repartition(shuffle_partitions(graph.sparkSession), "v").sortWithinPartitions("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "v"):
            vecs = b"".join(table_column(group, "vec").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([group.column("v")[0].as_py()], pa.int64()), pa.array([table_column(group, "u").to_pylist()], pa.list_(pa.int64())), pa.array([vecs], pa.binary())], names=["node", "near", "vecs"])

    return dealt.mapInArrow(run, "node long, near array<long>, vecs binary")


def search(lists: DataFrame, queries: DataFrame, width: int = BEAM) -> DataFrame:
    """The beam (q, x, s) of each query node (q, vec) when all of it is expanded."""
    beam = materialize(queries.select("q", F.col("q").alias("x"), F.lit(2.0).cast("float").alias("s"), F.lit(False).alias("done")), "beam")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vec"))
            near = batch.column("near")
            counts = near.value_lengths().to_numpy()
            u = near.flatten().to_numpy()
            vecs = np.frombuffer(b"".join(batch.column("vecs").to_pylist()), np.float16).reshape(len(u), -1).astype(np.float32)
            row = np.repeat(np.arange(batch.num_rows), counts)
            sims = np.einsum("ij,ij->i", vecs, x[row])
            better = sims > batch.column("last").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("q").to_numpy()[row][better]), pa.array(u[better]), pa.array(sims[better].astype(np.float32)), pa.array(np.zeros(int(better.sum()), bool))], names=["q", "x", "s", "done"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "q"):
            q, x, s, done = (table_column(group, c).to_numpy(zero_copy_only=False) for c in ("q", "x", "s", "done"))
            order = np.lexsort((~done, x))
            _, first = np.unique(x[order], return_index=True)
            one = order[first]
            top = one[np.lexsort((x[one], -s[one]))[:width]]
            yield pa.RecordBatch.from_arrays([pa.array(q[top]), pa.array(x[top]), pa.array(s[top]), pa.array(done[top])], names=["q", "x", "s", "done"])

    while True:
        open_ = beam.where(~F.col("done"))
        if open_.isEmpty():
            return beam.select("q", "x", "s")
        last = beam.groupBy("q").agg(F.when(F.count("*") >= width, F.min("s")).otherwise(-2.0).cast("float").alias("last"))
        asked = open_.select("q", "x").join(last, "q").join(queries, "q")
        fresh = asked.join(lists, F.col("x") == F.col("node")).select("q", "vec", "last", "near", "vecs").mapInArrow(expand, "q long, x long, s float, done boolean")
        both = beam.select("q", "x", "s", F.lit(True).alias("done")).union(fresh)
        after = materialize(both.repartition(shuffle_partitions(beam.sparkSession), "q").sortWithinPartitions("q").mapInArrow(keep, "q long, x long, s float, done boolean"), "beam")
        drop_stage(beam)
        beam = after


def measured(pairs: DataFrame) -> DataFrame:
    """Adds score, the cosine of the doubles in a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.array(batch.column(c).flatten()).reshape(batch.num_rows, -1) for c in ("a", "b"))
            # powers of two change no digit, and no square overflows or vanishes
            a, b = (np.ldexp(m, -np.frexp(np.abs(m).max(1, keepdims=True))[1]) for m in (a, b))
            scores = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("members"), pa.array(scores, pa.float64())], names=["q", "members", "score"])

    return pairs.select("q", "members", "a", "b").mapInArrow(run, "q long, members array<long>, score double")


def nearest(table: DataFrame, every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest found of each row whose vec_id ``every`` divides."""
    if k > NEAREST:
        raise ValueError(f"members of a node are kept for at most {NEAREST} neighbours")
    rows = taking_part(table)
    usual = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    size = usual["size"] if usual else 1
    rows = rows.where(F.col("size") == size)
    nodes = materialize(nodes_of(rows), "nodes")
    vectors = materialize(halved(nodes), "vectors")
    count = vectors.count()
    graph = graph_of(vectors, count, size)
    lists, forget = bucketed(lists_of(graph, vectors), "node", "lists")
    drop_stage(graph)
    asked = materialize(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("x").alias("q")).distinct(), "queries")
    own = asked.select("q").distinct().join(vectors, F.col("q") == F.col("node")).select("q", "vec")
    beam = search(lists, materialize(own, "asked"), beam_of(count))
    forget()
    drop_stage(vectors)
    of = nodes.select("node", "x", "members")
    pairs = beam.select("q", F.col("x").alias("found")).join(of.select(F.col("node").alias("q"), F.col("x").alias("a")), "q").join(of.select(F.col("node").alias("found"), F.col("x").alias("b"), "members"), "found")
    each = measured(pairs).select("q", "score", F.explode("members").alias("vec_id")).repartition(shuffle_partitions(table.sparkSession), "q")
    of_id = F.row_number().over(Window.partitionBy("q", "vec_id").orderBy(F.desc("score")))
    once = each.withColumn("n", of_id).where("n = 1")
    top = once.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= NEAREST + 1)
    found = asked.join(top, "q").where("query_id != vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
