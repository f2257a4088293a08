"""Repair of conversations' structure by dynamic programming over a trie of role and fault signatures.

A conversation's rows, by turn, become a signature: a letter for each row, its role's initial (s, u, a, or o for any
other; a capital for a truncated text), or d where the row has to go, being blank or a duplicate. Distinct signatures are sorted,
dealt out in ranges, and walked as a prefix trie in depth-first order: the layers of the dynamic programme, the cheapest
edits by the state that the roles are in, are kept for the path from the root, so each is computed once for all signatures
that share the prefix. A signature's end is a terminal node, where the answer is read off. An audit is the
edits' initials: Keep, Rerole, Delete, Insert; the repaired roles are ``(s?(ua)+)?``.

Rows of a conversation are ordered by turn (nulls first), then role, then the text's SHA-256, so results don't depend
on how rows arrive. Repeated rows count each: they lie beside each other, and all but the first are duplicates. A null role or text is
one blank; an empty role has no initial and is always in the wrong place. Null conv_ids are a conversation of their own. Extra columns
are left out. A conversation without rows has zeros, an empty audit and the empty text's hash.

Rows meet by conversation without their texts for the signature, in a stream of sorted rows that holds one letter for each; a duplicate is found
by the least turn of its role and text, which is aggregated before it is shuffled. The hash of a repaired
conversation is a chain over its texts, so each conversation is read by one task, a batch at a time.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, shuffle_partitions

#: White space of a blank text, and what each edit costs.
WHITE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the roles: nothing yet, after the system's, a user's, an assistant's. What has to come next, and where the roles may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
REQUIRED = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (NOTHING, ASSISTANT)
#: What a row's edit may be appended as: inserts before it, then its letter.
APPENDED = ["I" * n + letter for letter in "DKR" for n in range(3)]
NEVER = 1 << 60


def damage(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0 to 2) of each row, by the crc32 of ``conv_id:turn``: dropped, emptied, without [.!?], twice, a user's, or as it was."""
    spelled = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(spelled.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return table.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def prepared(table: DataFrame) -> DataFrame:
    """A table as it is, in the form that damage() gives."""
    return table.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).alias("copies"))


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal and signature of each conversation, those without a row left included."""
    end = F.rtrim("text", F.lit(WHITE))
    thin = rows.select("conv_id", "turn", "role", digest().alias("digest"), "copies", (end == "").alias("blank"), F.right(end, F.lit(1)).isin(".", "!", "?").alias("ended"))
    thin = materialize(thin.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("ended").alias("ended")), "turns")
    said = thin.where("copies > 0 and not blank").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    said = said.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")
    seen = thin.join(said, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.coalesce(F.struct("turn") > F.col("first"), F.lit(False)), "duplicate").when(~F.col("ended"), "truncated").otherwise("")
    seen = seen.select("conv_id", "turn", "role", "digest", "copies", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Conversation | None = None
        for batch in batches:
            done: list[Conversation] = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "copies", "initial", "fault"))
            for conv_id, turn, copies, initial, fault in zip(*columns, strict=True):
                if own is None or own.conv_id != conv_id:
                    done += [own] if own else []
                    own = Conversation(conv_id)
                if copies:
                    own.add(turn, copies, initial, fault)
            yield found(done, batch.column("conv_id").type)
        if own:
            yield found([own], batch.column("conv_id").type)

    def found(done: list[Conversation], type_: pa.DataType) -> pa.RecordBatch:
        longs = [pa.array([getattr(c, n) for c in done], pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal")]
        return pa.RecordBatch.from_arrays([pa.array([c.conv_id for c in done], type_), *longs, pa.array([c.signature.decode() for c in done], pa.string())], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"])

    dealt = seen.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    return dealt.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string")


class Conversation:
    """What is known of a conversation from its rows so far."""

    def __init__(self, conv_id):
        self.conv_id, self.signature, self.last = conv_id, bytearray(), None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = None

    def add(self, turn: int | None, copies: int, initial: str, fault: str) -> None:
        if turn is not None and turn != self.most:
            self.turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += copies - 1  # no role may follow itself
        self.last = initial
        letter = initial if initial in ("s", "u", "a") else "o"
        if fault == "blank":
            self.blank += copies
        else:
            self.duplicate += copies - (fault != "duplicate")
            self.truncated += fault == "truncated"
        first = "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        self.signature += first.encode() + b"d" * (copies - 1)

    @property
    def gaps(self) -> int:
        return self.most - self.least + 1 - self.turns if self.turns else 0


def moves(state: int, letter: str) -> list[tuple[int, int, int]]:
    """Next state, cost and place in APPENDED of each way to deal with a row of this letter."""
    found, inserted = [], state
    extra = TRUNCATED if letter.isupper() else 0
    for n in range(3):
        found.append((inserted, INSERT * n + DELETE, n))
        if letter != "d":
            role = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(letter.lower())
            if role is not None and (role == REQUIRED[inserted] or role == SYSTEM and inserted == NOTHING):
                found.append((role, INSERT * n + extra, 3 + n))
            found.append((REQUIRED[inserted], INSERT * n + REROLE + extra, 6 + n))
        inserted = REQUIRED[inserted]
    return found


class Layers:
    """The layers of one path of the trie. For each state: its least cost, the rank of its audit among the states', and the state and edits before.

    Of equal costs the ASCII-least audit stays. Audits of two states end with a row's edit each and have as many of those, so
    none is the start of the other, and ranks of the layer before with what is appended tell which is less.
    """

    def __init__(self):
        self.path = ""
        self.costs, self.ranks, self.before, self.appended = array("q", [0, NEVER, NEVER, NEVER]), bytearray(4), bytearray(4), bytearray(4)
        self.known: dict[tuple, tuple] = {}

    def next(self, costs: tuple[int, ...], ranks: tuple[int, ...], letter: str) -> tuple:
        best: list[tuple | None] = [None] * 4
        for state in range(4):
            if costs[state] < NEVER:
                for to, cost, way in moves(state, letter):
                    made = (costs[state] + cost, ranks[state], APPENDED[way], state, way)
                    if best[to] is None or made < best[to]:
                        best[to] = made
        order = sorted((b[1], b[2], to) for to, b in enumerate(best) if b)
        rank = {to: n for n, (_, _, to) in enumerate(order)}
        return tuple(b[0] if b else NEVER for b in best), tuple(rank.get(to, 0) for to in range(4)), bytes(b[3] if b else 0 for b in best), bytes(b[4] if b else 0 for b in best)

    def go(self, signature: str) -> None:
        """Goes back to what the path shares with the signature, then on to its end."""
        shared = len(shared_start(self.path, signature))
        for part in (self.costs, self.ranks, self.before, self.appended):
            del part[4 * (shared + 1) :]
        for letter in signature[shared:]:
            costs, ranks = self.costs[-4:], tuple(self.ranks[-4:])
            least = min(costs)
            key = (tuple(c - least if c < NEVER else NEVER for c in costs), ranks, letter)
            if key not in self.known:
                self.known[key] = self.next(*key)
            after, ranks, before, appended = self.known[key]
            self.costs.extend(c + least if c < NEVER else NEVER for c in after)
            self.ranks += bytes(ranks)
            self.before += before
            self.appended += appended
        self.path = signature

    def answer(self) -> tuple[int, str]:
        """Cost and audit at the path's end."""
        at = len(self.ranks) - 4
        ends = []
        for state in range(4):
            inserted = state
            for n in range(3):
                if inserted in ENDS and self.costs[at + state] < NEVER:
                    ends.append((self.costs[at + state] + INSERT * n, self.ranks[at + state], "I" * n, state))
                inserted = REQUIRED[inserted]
        cost, _, closing, state = min(ends)
        parts = [closing]
        while at:
            parts.append(APPENDED[self.appended[at + state]])
            state = self.before[at + state]
            at -= 4
        return cost, "".join(reversed(parts))


def shared_start(a: str, b: str) -> str:
    """The longest common prefix, by halves."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return a[:low]


def answers(signature: DataFrame) -> DataFrame:
    """signature, cost and audit of each distinct signature, by one walk over a range of the sorted ones in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = Layers()
        for batch in batches:
            given, costs, audits, size = batch.column("signature").to_pylist(), [], [], 0
            start = 0
            for n, s in enumerate(given, 1):
                layers.go(s)
                cost, audit = layers.answer()
                costs.append(cost)
                audits.append(audit)
                size += len(audit)
                if size > 1 << 22 or n == len(given):
                    yield pa.RecordBatch.from_arrays([pa.array(given[start:n], pa.string()), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=["signature", "cost", "audit"])
                    costs, audits, size, start = [], [], 0, n

    distinct = signature.select("signature").distinct().repartitionByRange(shuffle_partitions(signature.sparkSession), "signature")
    return distinct.sortWithinPartitions("signature").mapInArrow(run, "signature string, cost long, audit string")


def audited(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of rows (of damage() or prepared())."""
    found = materialize(signatures(rows), "signatures")
    return found.join(answers(found), "signature").drop("signature")


def followed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows, in the order of their signature."""
    whole = rows.where("copies > 0").select("conv_id", F.lit(None).cast("struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string>").alias("found"), "turn", "role", digest().alias("digest"), "text", F.expr("explode(sequence(1, copies))").alias("copy"))
    heads = audits.select("conv_id", F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").alias("found"), F.lit(None).cast(dict(rows.dtypes)["turn"]).alias("turn"), *(F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("digest", "binary"), ("text", "string"))), F.lit(0).alias("copy"))
    both = heads.unionByName(whole).withColumn("row", F.col("found").isNull())
    return both.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "row", "turn", "role", "digest", "copy").drop("digest", "copy")


class Replay:
    """Applies an audit to the rows of its conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = REQUIRED[self.state]
            yield "I", ROLES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of what stands for the row and before it."""
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield edit, role, text
        elif edit == "R":
            self.state = REQUIRED[self.state]
            yield edit, ROLES[self.state], text


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), turn (null for inserted ones), role and text of each row of the repaired conversations."""
    kinds = dict(rows.dtypes)
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place, conv_id = None, 0, None
        for batch in batches:
            out: list[tuple] = []

            def put(turn, made: Iterator[tuple[str, str, str]]) -> None:
                nonlocal place
                for edit, role, text in made:
                    out.append((conv_id, place, edit, None if edit == "I" else turn, role, text))
                    place += 1

            for each, head, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "found", "turn", "role", "text")), strict=True):
                if head is not None:
                    if own:
                        put(None, own.inserts())
                    own, place, conv_id = Replay(head["audit"]), 0, each
                else:
                    put(turn, own.row(role, text))
            types = (batch.schema.field("conv_id").type, pa.int64(), pa.string(), batch.schema.field("turn").type, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 6, types, strict=True)], names=["conv_id", "place", "edit", "turn", "role", "text"])
        if own:
            last = [(conv_id, place + n, e, None, r, t) for n, (e, r, t) in enumerate(own.inserts())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*last, strict=True)) or [[]] * 6, types, strict=True)], names=["conv_id", "place", "edit", "turn", "role", "text"])

    return followed(rows, audits).mapInArrow(run, f"conv_id {kinds['conv_id']}, place long, edit string, turn {kinds['turn']}, role string, text string")


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """audits with repaired_sha256, the hash of the repaired conversation's ``role:text``, joined by newlines, without writing it out."""
    bounded_batches(rows.sparkSession)
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha, first, head, conv_id = None, None, True, None, None

        def put(made: Iterator[tuple[str, str, str]]) -> None:
            nonlocal first
            for _, role, text in made:
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False

        def ended() -> tuple:
            put(own.inserts())
            return (conv_id, *(head[c] for c in longs), head["audit"], sha.hexdigest())

        def found(done: list[tuple], type_: pa.DataType) -> pa.RecordBatch:
            types = (type_, *[pa.int64()] * len(longs), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done, strict=True)) or [[]] * len(types), types, strict=True)], names=["conv_id", *longs, "audit", "repaired_sha256"])

        for batch in batches:
            done: list[tuple] = []
            for each, given, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "found", "role", "text")), strict=True):
                if given is not None:
                    done += [ended()] if own else []
                    own, sha, first, head, conv_id = Replay(given["audit"]), hashlib.sha256(), True, given, each
                else:
                    put(own.row(role, text))
            yield found(done, batch.schema.field("conv_id").type)
        if own:
            yield found([ended()], batch.schema.field("conv_id").type)

    return followed(rows, audits).mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, {', '.join(f'{c} long' for c in longs)}, audit string, repaired_sha256 string")


def repair(table: DataFrame) -> DataFrame:
    """The repaired rows of a table of conversations as it is."""
    rows = prepared(table)
    return repaired(rows, audited(rows))


def damaged_and_repaired(table: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation after damage()."""
    rows = damage(table)
    return digests(rows, audited(rows))
