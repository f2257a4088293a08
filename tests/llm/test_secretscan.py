import hashlib
import random
import re

from pyspark.sql import functions as F

from reflume.llm import secretscan as ss

from .cases import documents, none

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_kinds_equal_their_patterns():
    for text in ("token: token: abcdef", "TOKEN==abcdefg", "AKIAAKIA" + "A" * 13, "AKIA12 AKIA" + "Z9" * 9, "0123456789abcdef" * 3, "apikey='a.b/c=d-e'", "K token=abſcdefg", "é api_key : xxxxxx,secret=12345"):
        assert [c[:3] for c in ss.candidates(text) if c[1] < 3] == base(text), text


def test_ownership_separates_examples_from_live(spark):
    example, live = "f0e1d2c3b4a5968778695a4b3c2d1e0f", "9a8b7c6d5e4f30211203f4e5d6c7b8a9"
    loose = "Zx81Qw72Er63Ty54Ui45Op"
    rows = [(n, f"token = {example} and {loose if n == 2 else ''}", f"owner{n}/repo") for n in range(6)] + [(10, f"token = {live}", "owner1/repo"), (11, f"password: {live}", "owner1/other"), (12, None, None), (13, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in ss.scan(docs).collect()}
    assert len(found) == 10 and found[0].n_example == 2 and found[0].n_live == 0
    assert found[10].n_live == found[11].n_live == 2
    assert found[2].spans.count("random") == 1 and found[2].n_live == 1
    assert found[12].spans == found[13].spans == ""
    masked = {r.doc_id: r.text for r in ss.redact(docs.withColumn("n_chars", F.length("text").cast("long"))).collect()}
    assert example in masked[0] and live not in masked[10] and masked[10] == "token = [SECRET]" and masked[12] is None


def test_odd_rows(spark):
    docs = documents(spark)
    found = ss.scan(docs).collect()
    assert len(found) == docs.count()
    assert [r.spans for r in found if r.doc_id == -9] == ["assign:528:548"] or [r.n_assign for r in found if r.doc_id == -9] == [1]
    again = ss.redact(docs)
    assert again.columns == docs.columns and again.count() == docs.count()
    assert ss.scan(none(spark)).count() == 0 and ss.redact(none(spark)).count() == 0


def test_the_query_equals_a_loop(spark):
    """Counts, digest, spans and ownership of every row, with values in several repositories of one owner and of many."""
    rng = random.Random(4)
    value = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    example, shared, one, loose = value(32), value(32), value(32), "Zx81Qw72Er63Ty54Ui45Op"
    rows = [(n, f"see token = {example} or {loose}", f"o{n % 6}/r{n}") for n in range(9)]
    rows += [(20 + n, f"secret: {shared}, AKIA{'Q' * 17}", f"o{n}/r") for n in range(3)]
    rows += [(30 + n, f"api_key='{one}'", f"o1/r{n}") for n in range(7)] + [(40, None, "o1/r"), (41, "", None), (42, f"password {value(30)} secret=ab", None), (42, "token:abcdef", "")]
    owners: dict[str, set[str]] = {}
    places = {}
    for n, (_, t, s) in enumerate(rows):
        found = [(a, k, b, t[x:y]) for a, k, b, x, y in ss.candidates(t or "")]
        places[n] = found
        for *_, v in found:
            owners.setdefault(v, set()).add((s or "").split("/")[0])
    wanted = []
    for n, (i, t, _) in enumerate(rows):
        spans = base(t)
        status = {v: "example" if len(owners[v]) >= 5 else "live" if len(owners[v]) == 1 and ss.bits(v) >= 3.0 else "shared" for *_, v in places[n]}
        kept = [(a, k, b, v) for a, k, b, v in places[n] if ss.KINDS[k] != "random" or status[v] != "example"]
        said = ",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        wanted.append((i, *(sum(k == kind for _, k, _ in spans) for kind in range(3)), hashlib.sha256(said.encode()).hexdigest(), ",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, k, b, _ in kept), sum(status[v] == "live" for *_, v in kept), sum(status[v] == "example" for *_, v in kept)))
    found = ss.scan(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert sorted(map(tuple, found)) == sorted(wanted)
    assert {r.n_example > 0 for r in found if r.doc_id < 9} == {True} and all(r.n_live == 2 for r in found if 30 <= r.doc_id < 40)


def test_masking_keeps_columns_of_any_name(spark):
    rows = [(1, "token = abcdef123456", "a/b", "i", "k", "f", "o", "t"), (1, "nothing", "a/b", "i2", "k2", "f2", "o2", "t2"), (None, None, None, "i3", None, "f3", None, "t3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, _key string, _findings string, _key_of string, _doc string")
    again = ss.redact(docs)
    assert again.columns == docs.columns
    assert sorted(map(tuple, again.collect()), key=repr) == sorted([(1, "token = [SECRET]", *rows[0][2:]), *rows[1:]], key=repr)
