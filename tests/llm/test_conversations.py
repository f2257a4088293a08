import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from reflume.llm import conversations
from reflume.llm.queries import op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, found string, copies int, audit int"
WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Cost, audit and roles by the cheapest, then ASCII-least, whole strings of edits. rows: role, must go, truncated."""
    heap = [(0, "", 0, "")]
    while heap:
        cost, audit, n, roles = heapq.heappop(heap)
        if n == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        if len(audit) > 3 * len(rows) + 3:
            continue
        for role in "ua":
            if re.fullmatch("s?(ua)*u?", roles + role):
                heapq.heappush(heap, (cost + 2, audit + "I", n, roles + role))
        if n < len(rows):
            role, gone, truncated = rows[n]
            heapq.heappush(heap, (cost + 3, audit + "D", n + 1, roles))
            if not gone:
                if role and re.fullmatch("s?(ua)*u?", roles + role[0]):
                    heapq.heappush(heap, (cost + truncated, audit + "K", n + 1, roles + role[0]))
                for to in "ua":
                    if re.fullmatch("s?(ua)*u?", roles + to):
                        heapq.heappush(heap, (cost + 2 + truncated, audit + "R", n + 1, roles + to))


def brute(table):
    """The query's rows, conversation by conversation."""
    groups = {}
    for r in table:
        groups.setdefault(r.conv_id, []).append(r)
    out = {}
    for conv_id, given in groups.items():
        rows = []
        for r in given:
            kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (r.conv_id, r.turn)).encode()) % 20
            role, text = (" " if x is None else x for x in (r.role, r.text))
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(r.turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            end = text.rstrip(WHITE)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        cost, audit = cheapest([(role, f in ("blank", "duplicate"), f == "truncated") for (_, role, _), f in zip(rows, faults, strict=True)])
        left, said, last = iter(rows), [], ""
        for edit in audit:
            _, role, text = next(left) if edit != "I" else (0, "", "")
            if edit != "D":
                role = role if edit == "K" else "assistant" if last == "u" else "user"
                last = role[0]
                said.append(f"{role}:{text}")
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        out[conv_id] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def odd_rows():
    rng = random.Random(4)
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "users"])
            text = rng.choice(["Fine.", "Fine.", "Yes!", "cut off", " \t", "", None, "why?\n ", "ok.\u0085", "x　", "é…"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 5, 2]), role, text))
    rows += [rows[0], rows[0], (None, 0, "user", "a."), (None, 1, "assistant", "b."), (None, None, "user", "c"), (-5, -3, "user", "x" * 50_000 + "."), (-5, 9, "assistant", "y.")]
    return [(*r, "f", n, n) for n, r in enumerate(rows)]


def test_query_equals_brute_force(spark, tmp_path):
    table = spark.createDataFrame(odd_rows(), SCHEMA)
    table.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    found = op11_conversation_repair(spark, str(tmp_path))
    assert found.columns == ["conv_id", *COLUMNS]
    rows = found.collect()
    want = brute(table.collect())
    assert len(rows) == len(want)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == want[r.conv_id], r.conv_id


def test_whole_small_table_equals_brute_force(spark):
    found = op11_conversation_repair(spark, "/root/testdata/sf0.001").collect()
    want = brute(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect())
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found} == want


def test_layers_equal_whole_strings():
    """All signatures of up to four letters, walked in their order."""
    layers = conversations.Layers()
    for s in sorted("".join(p) for n in range(4) for p in product("suaoSUAOd", repeat=n)):
        layers.go(s)
        rows = [({"s": "s", "u": "u", "a": "a"}.get(c.lower(), "x"), c == "d", c.isupper()) for c in s]
        assert layers.answer() == cheapest(rows), s


def test_prefixes_are_worked_out_once(monkeypatch):
    layers, steps = conversations.Layers(), []
    layers.go("suaua" * 2000)
    before = len(layers.ranks)
    monkeypatch.setattr(layers, "next", lambda *a: steps.append(a))
    layers.go("suaua" * 2000)  # nothing new
    assert len(layers.ranks) == before and not steps
    layers.go("suaua")
    assert layers.answer()[1] == "KKKKK" and len(layers.ranks) == 4 * 6


def test_a_long_conversation_and_a_hot_signature(spark):
    long_ = [(7, n, "user" if n % 2 == 0 else "assistant", f"turn {n}.") for n in range(20_000)]
    hot = [(100 + c, n, "user" if n % 2 == 0 else "assistant", "Same.") for c in range(500) for n in range(4)]
    table = spark.createDataFrame([(*r, None, 0, 0) for r in long_ + hot], SCHEMA)
    rows = conversations.prepared(table)
    audits = {r.conv_id: r for r in conversations.audited(rows).collect()}
    assert audits[7].cost == 0 and audits[7].audit == "K" * 20_000 and audits[7].gaps == 0
    assert len(audits) == 501 and all(audits[100 + c].audit == audits[100].audit and audits[100].duplicate == 2 for c in range(500))


def test_repaired_rows_alternate_and_hash_alike(spark):
    table = spark.createDataFrame(odd_rows(), SCHEMA)
    rows = conversations.prepared(table)
    audits = conversations.audited(rows)
    made = {}
    for r in sorted(conversations.repaired(rows, audits).collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.place)):
        made.setdefault(r.conv_id, []).append(r)
    for own in made.values():
        assert [r.place for r in own] == list(range(len(own)))
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in own))
        assert all(r.text == "" and r.turn is None for r in own if r.edit == "I")
    hashes = {r.conv_id: r.repaired_sha256 for r in conversations.digests(rows, audits).collect()}
    for conv_id, sha in hashes.items():
        assert sha == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in made.get(conv_id, [])).encode()).hexdigest()


def test_empty_table_and_dropped_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.damaged_and_repaired(none).count() == 0 and conversations.repair(none).count() == 0
    gone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = conversations.damaged_and_repaired(spark.createDataFrame([(gone, 0, "user", "Hi.", "", 0, 0)], SCHEMA)).first()
    assert (row.conv_id, row.gaps, row.blank, row.illegal, row.cost, row.audit, row.repaired_sha256) == (gone, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize(("a", "b", "n"), [("", "abc", 0), ("abc", "abc", 3), ("abd", "abc", 2), ("x", "abc", 0), ("ab" * 500, "ab" * 499 + "ac", 999)])
def test_shared_start(a, b, n):
    assert len(conversations.shared_start(a, b)) == n
