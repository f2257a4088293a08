"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's documents, ordered by the md5 of doc_id, are cut into blocks of BLOCK_ROWS. With a weight
of a / PERIOD, block j (from 0) of a source is released at slot floor(j * PERIOD / a) and
due by slot ceil((j + 1) * PERIOD / a). At each slot the released block with the earliest
deadline is taken, ties to the source that sorts first, so at every slot each source is
less than one block from its share. As weights are whole parts of PERIOD and sum up to it, the schedule
repeats: it is worked out for one period, in one row, and every block finds its slot by a
join with that table of PERIOD rows. The period grows with more sources than it has slots.

Where a row can't hold the work, sources are scheduled as a tree: the largest ones and groups of the others share out the
period, then the sources of a group share out the group's slots, each by the same rule in a row of its own, in as many levels as it
takes. A source that stands alone at the first level is still less than one block from its share; one with a parts in a
group of A is less than 1 + a / A, so less than two, and with more levels as much again for each further group around it.

All documents get a slot. A source that runs out leaves its slots empty; up to the first
empty slot, the horizon, the mixture has its target weights. Beyond it only the surplus of sources
over the most share is ever left out. A null source counts as the
empty name; null ids come first in their source. Repeated rows have a place each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, shuffle_partitions

BLOCK_ROWS, PERIOD = 8, 1000
#: No source's target is over this share, unless there are too few of them.
MOST_SHARE = 1 / 3
#: Sources times slots that are worked out in one row; beyond, sources are scheduled as a tree, with FEWEST children of a node at least.
MOST_STEPS, FEWEST = 5_000_000, 8
_HEX, _SLOTS = 8, 128
MADE = ("block", "release", "deadline", "slot", "place")


def source_of(docs: DataFrame) -> DataFrame:
    """_source of each row and, in _doc, all that the row has: no name of docs meets one from here."""
    return docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), F.struct(*docs.columns).alias("_doc"))


def targets(docs: DataFrame, period: int = PERIOD, most_share: float = MOST_SHARE) -> DataFrame:
    """_source and parts of the period: shares of the rows, none over most_share, by largest remainders; each has a part at least.

    The period has to have as many slots as there are sources, as fitted() sees to.
    """
    rows = source_of(docs).groupBy("_source").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # a row for each source
    sized = rows.withColumn("total", F.sum("n").over(every)).withColumn("sources", F.count("*").over(every))
    cap = F.greatest(F.lit(float(most_share)), 1.0 / F.col("sources"))
    over = F.col("n") > cap * F.col("total")
    capped = sized.withColumn("over", over).withColumn("n_over", F.count_if("over").over(every)).withColumn("under", F.sum(F.when(F.col("over"), 0).otherwise(F.col("n"))).over(every))
    rest = 1.0 - cap * F.col("n_over")
    share = F.when(F.col("over"), cap).otherwise(rest * F.col("n") / F.col("under"))
    share = F.when(F.col("under") == 0, 1.0 / F.col("sources")).otherwise(share)
    exact = capped.withColumn("exact", share * (F.lit(period) - F.col("sources"))).withColumn("whole", F.floor("exact"))
    left = F.lit(period) - F.col("sources") - F.sum("whole").over(every)
    by_rest = F.row_number().over(every.orderBy(F.desc(F.col("exact") - F.col("whole")), "_source"))
    return exact.withColumn("left", left).withColumn("place", by_rest).select("_source", (F.col("whole") + 1 + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).cast("long").alias("parts"))


def fitted(period: int, sources: int) -> int:
    """The period, or where there are more sources than its slots, the least multiple with two slots a source."""
    return period if sources <= period else period * -(-2 * sources // period)


def in_one_row(period: int, sources: int) -> bool:
    return sources * period <= MOST_STEPS


def folded(rows: DataFrame) -> DataFrame:
    """node, k (a slot of the node, from 0), name and turn: earliest deadline first among the names of each node, whose parts are its slots.

    The names' next turns are an array that is folded over the slots within one row.
    """
    names = rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("name", "parts"))).alias("s"), F.sum("parts").alias("period"))
    nothing = "cast(array() as array<struct<i:int,turn:long>>)"
    pick = """array_min(filter(transform(s, (x, i) -> if(
                state.done[i] < x.parts and state.done[i] * period <= t * x.parts + x.parts - 1,
                named_struct('due', ((state.done[i] + 1) * period + x.parts - 1) div x.parts, 'i', i), null)), y -> y is not null))"""
    taken = "concat(st.taken, array(named_struct('i', coalesce(pick.i, -1), 'turn', coalesce(st.done[pick.i], -1L))))"
    slot = f"(state, t) -> aggregate(array({pick}), state, (st, pick) -> named_struct('done', transform(st.done, (d, i) -> if(i = pick.i, d + 1L, d)), 'all', st.all, 'taken', {taken}))"
    # Slots are gathered some at a time, so that none is copied more than a few times.
    several = f"(o, b) -> aggregate(sequence(b, least(b + {_SLOTS - 1}L, period - 1L)), o, {slot}, st -> named_struct('done', st.done, 'all', concat(st.all, array(st.taken)), 'taken', {nothing}))"
    step = f"flatten(aggregate(sequence(0L, period - 1L, {_SLOTS}L), named_struct('done', transform(s, x -> 0L), 'all', array({nothing}), 'taken', {nothing}), {several}).all)"
    slots = names.select("node", "s", F.posexplode(F.expr(step)).alias("k", "x")).where("x.i >= 0")
    return slots.select("node", F.col("k").cast("long").alias("k"), F.expr("s[x.i].name").alias("name"), F.col("x.turn").alias("turn"))


def schedule(weights: DataFrame, period: int = PERIOD, sources: int | None = None) -> DataFrame:
    """_source, parts, turn (a block of its period, from 0), turn_slot: earliest deadline first over one period, in one row or as a tree."""
    named = weights.select(F.lit("").alias("node"), F.col("_source").alias("name"), F.col("parts").cast("long").alias("parts"))
    if in_one_row(period, weights.count() if sources is None else sources):
        found = folded(named).select(F.col("name").alias("_source"), "turn", F.col("k").alias("turn_slot"))
    else:
        found = of_tree(named, period)
    return found.join(weights, "_source").select("_source", "parts", "turn", "turn_slot")


def of_tree(named: DataFrame, period: int) -> DataFrame:
    """_source, turn and turn_slot of sources (node, name, parts) that one row can't hold."""
    slots = named.sparkSession.range(period).select(F.lit("").alias("node"), F.col("id").alias("k"), F.col("id").alias("slot"))
    found = None
    while True:
        node = Window.partitionBy("node")  # a row for each source
        every, slots_of = F.count("*").over(node), F.sum("parts").over(node)
        groups = F.greatest(F.lit(FEWEST), F.floor(F.lit(MOST_STEPS) / F.col("of")))
        rows = named.withColumn("n", every).withColumn("of", slots_of).withColumn("groups", groups).withColumn("half", F.floor(F.col("groups") / 2))
        rows = rows.withColumn("place", F.row_number().over(node.orderBy(F.desc("parts"), "name")))
        rows = rows.withColumn("split", (F.col("n") * F.col("of") > MOST_STEPS) & (F.col("n") > F.col("groups")))
        child = F.when(F.col("place") <= F.col("half"), F.col("place") - 1).otherwise(F.col("half") + F.col("place") % (F.col("groups") - F.col("half")))
        rows = materialize(rows.select("node", "name", "parts", "split", F.lpad(child.cast("string"), 9, "0").alias("child")), "level")
        ends = folded(rows.where("not split").select("node", "name", "parts")).join(slots, ["node", "k"]).select(F.col("name").alias("_source"), "turn", F.col("slot").alias("turn_slot"))
        found = ends if found is None else found.union(ends)
        if rows.where("split").isEmpty():
            return found
        inner = F.concat_ws("/", "node", "child").alias("node")
        children = rows.where("split").groupBy("node", F.col("child").alias("name")).agg(F.sum("parts").alias("parts"))
        slots = materialize(folded(children).join(slots, ["node", "k"]).select(F.concat_ws("/", "node", "name").alias("node"), F.col("turn").alias("k"), "slot"), "slots")
        named = rows.where("split").select(inner, "name", "parts")


def ranked(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """_doc and _source of each row, and rank, its place in its source; with weights, its source's parts too.

    Sources are split by the first digits of the md5, so that a large one is ranked in
    many tasks; counts of the parts, a few for each source and partition, give the ranks before each.
    """
    parts = 4 * shuffle_partitions(docs.sparkSession)
    md5 = F.md5(F.coalesce(F.col("_doc.doc_id").cast("string"), F.lit("")))
    keyed = source_of(docs).withColumn("_md5", md5)
    keyed = keyed.withColumn("_part", F.floor(F.conv(F.substring("_md5", 1, _HEX), 16, 10).cast("long") * parts / (1 << 4 * _HEX)).cast("int"))
    counts = keyed.groupBy("_source", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_source", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    offsets = offsets if weights is None else offsets.join(weights, "_source")
    within = Window.partitionBy("_source", "_part").orderBy("_md5", *([F.col("_doc.text")] if "text" in docs.columns else []))
    numbered = keyed.withColumn("_n", F.row_number().over(within))
    return numbered.join(offsets, ["_source", "_part"]).withColumn("rank", F.col("_before") + F.col("_n") - 1)


def placed(docs: DataFrame, block_rows: int = BLOCK_ROWS, period: int = PERIOD, most_share: float = MOST_SHARE) -> DataFrame:
    """_source, _doc and rank of each row, and what MADE names."""
    sources = source_of(docs).select("_source").distinct().count()
    period = fitted(period, sources)
    weights = targets(docs, period, most_share)
    table = schedule(weights, period, sources).withColumnRenamed("_source", "_s")
    if in_one_row(period, sources):
        table = F.broadcast(table)
        rows = ranked(docs).join(F.broadcast(weights.withColumnRenamed("_source", "_p")), F.col("_source") == F.col("_p"))
    else:
        rows = ranked(docs, weights)
    rows = rows.withColumn("block", F.floor(F.col("rank") / block_rows))
    rows = rows.withColumn("_turn", F.col("block") % F.col("parts")).withColumn("_period", F.floor(F.col("block") / F.col("parts")))
    table = table.withColumnRenamed("parts", "_parts")
    rows = rows.join(table, (F.col("_source") == F.col("_s")) & (F.col("_turn") == F.col("turn")))
    slot = F.col("_period") * period + F.col("turn_slot")
    return rows.select(
        "_source",
        "_doc",
        "rank",
        F.col("block"),
        F.floor(F.col("block") * period / F.col("parts")).alias("release"),
        F.ceil((F.col("block") + 1) * period / F.col("parts")).alias("deadline"),
        slot.alias("slot"),
        (slot * block_rows + F.col("rank") % block_rows).alias("place"),
    )


def mix(docs: DataFrame, block_rows: int = BLOCK_ROWS, period: int = PERIOD, most_share: float = MOST_SHARE) -> DataFrame:
    """docs with block, release, deadline, slot and place (slot, then place within the block) of each row; columns of those names are replaced."""
    return placed(docs, block_rows, period, most_share).select(*(F.col(f"_doc.{c}") for c in docs.columns if c not in MADE), *MADE)


def horizon(docs: DataFrame, block_rows: int = BLOCK_ROWS, period: int = PERIOD, most_share: float = MOST_SHARE) -> DataFrame:
    """One row: the first slot that a source leaves empty or fills in part."""
    sizes = source_of(docs).groupBy("_source").agg(F.count("*").alias("n"))
    sources = sizes.count()
    period = fitted(period, sources)
    weights = schedule(targets(docs, period, most_share), period, sources)
    full = F.floor(F.col("n") / block_rows)  # the first block that isn't whole
    ends = weights.join(sizes, "_source").where(full % F.col("parts") == F.col("turn"))
    return ends.agg(F.min(F.floor(full / F.col("parts")) * period + F.col("turn_slot")).alias("horizon"))


def mixture(docs: DataFrame, block_rows: int = BLOCK_ROWS, period: int = PERIOD, most_share: float = MOST_SHARE) -> DataFrame:
    """The documents before the horizon, those that have the target weights, in the order of their places.

    The first source that runs out ends it for all of them; without_surplus() keeps the rest.
    """
    placed = mix(docs, block_rows, period, most_share).join(F.broadcast(horizon(docs, block_rows, period, most_share)), F.col("slot") < F.col("horizon"))
    return placed.orderBy("place").select(*docs.columns)


def surplus(docs: DataFrame, most_share: float = MOST_SHARE) -> DataFrame:
    """_source and most, the rows it may keep, of the few sources with over most_share of the rows: so many that each is that share of what is kept."""
    sizes = source_of(docs).groupBy("_source").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # a row for each source
    sized = sizes.withColumn("total", F.sum("n").over(every)).withColumn("cap", F.greatest(F.lit(float(most_share)), 1.0 / F.count("*").over(every)))
    over = sized.withColumn("over", F.col("n") > F.col("cap") * F.col("total"))
    rest = over.withColumn("free", 1.0 - F.col("cap") * F.count_if("over").over(every)).withColumn("under", F.sum(F.when(F.col("over"), 0).otherwise(F.col("n"))).over(every))
    most = F.floor(F.col("cap") * F.col("under") / F.col("free") + 1e-6)
    return rest.where("over and under > 0 and free > 0").select("_source", most.alias("most"))


def without_surplus(docs: DataFrame, block_rows: int = BLOCK_ROWS, period: int = PERIOD, most_share: float = MOST_SHARE) -> DataFrame:
    """All documents but the surplus of sources over most_share, the last ones by their ranks, in the order of their places.

    Sources that run out leave their slots empty, which ends nothing.
    """
    over = F.broadcast(surplus(docs, most_share).withColumnRenamed("_source", "_over"))
    rows = placed(docs, block_rows, period, most_share).join(over, F.col("_source") == F.col("_over"), "left")
    return rows.where(F.col("most").isNull() | (F.col("rank") < F.col("most"))).orderBy("place").select("_doc.*")


def oracle() -> str:
    """DuckDB SQL for the rows of op5 over the table documents."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS s, md5(coalesce(doc_id::VARCHAR, '')) AS h, text FROM documents),
c AS (SELECT s, count(*) AS n FROM d GROUP BY s),
z AS (SELECT *, sum(n) OVER () AS total, count(*) OVER () AS k FROM c),
o AS (SELECT *, greatest({MOST_SHARE!r}::DOUBLE, 1.0::DOUBLE / k) AS cap FROM z),
u AS (SELECT *, n > cap * total AS over, count(*) FILTER (n > cap * total) OVER () AS n_over, coalesce(sum(n) FILTER (n <= cap * total) OVER (), 0) AS under FROM o),
e AS (SELECT *, (CASE WHEN under = 0 THEN 1.0::DOUBLE / k WHEN over THEN cap ELSE (1.0::DOUBLE - cap * n_over) * n / under END) * ({PERIOD} - k) AS exact FROM u),
w AS (SELECT s, (floor(exact) + 1 + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, s) <= {PERIOD} - k - sum(floor(exact)) OVER () THEN 1 ELSE 0 END)::BIGINT AS a FROM e),
l AS (SELECT list(a ORDER BY s) AS a, list(s ORDER BY s) AS s FROM w),
r(t, done, pick) AS (
  SELECT 0, list_transform(a, lambda x: 0::BIGINT), 0::BIGINT FROM l
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), p
  FROM (SELECT t, done, (list_min(list_filter(list_transform(range(1, len(a) + 1), lambda i:
          CASE WHEN done[i] < a[i] AND done[i] * {PERIOD} <= t * a[i] + a[i] - 1 THEN ((done[i] + 1) * {PERIOD} + a[i] - 1) // a[i] * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000)::BIGINT AS p
        FROM r, l WHERE t < {PERIOD})),
q AS (SELECT l.s[pick] AS s, l.a[pick] AS a, (done[pick] - 1)::BIGINT AS turn, (t - 1)::BIGINT AS turn_slot FROM r, l WHERE t > 0),
b AS (SELECT doc_id, s, (row_number() OVER (PARTITION BY s ORDER BY h, text) - 1)::BIGINT AS rank FROM d),
f AS (SELECT b.*, rank // {BLOCK_ROWS} AS block, a FROM b JOIN w USING (s))
SELECT doc_id, f.s AS source, block::BIGINT AS block, (block * {PERIOD} // f.a)::BIGINT AS release, (((block + 1) * {PERIOD} + f.a - 1) // f.a)::BIGINT AS deadline,
       (block // f.a * {PERIOD} + turn_slot)::BIGINT AS slot, ((block // f.a * {PERIOD} + turn_slot) * {BLOCK_ROWS} + rank % {BLOCK_ROWS})::BIGINT AS place
FROM f JOIN q ON q.s = f.s AND q.turn = block % f.a"""
