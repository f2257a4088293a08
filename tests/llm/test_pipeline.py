import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from reflume.llm import bpe, mixing, queries, secretscan
from reflume.llm.common import materialize
from reflume.llm.queries import tokenizer

from .cases import documents, none
from .test_jaccard import brute, copies


def test_stages_pass_on_the_columns(spark):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    start = docs
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, ""), name)
        assert docs.columns == start.columns
    rows = {r.doc_id: r for r in docs.collect()}
    assert {1, 2, 3, 4, 5, 8}.isdisjoint(rows)
    out = {r.doc_id: r for r in pipeline.encoding(spark, docs, "").collect()}
    own = bpe.Coder(tokenizer("byte_bpe_50k.json"))
    for i, r in rows.items():
        assert out[i].ids_sha256 == hashlib.sha256(own.encode([r.text])[0].astype("<u4").tobytes()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() and len(r.text) == r.n_chars


def test_nothing_learned_rejects_nothing(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(map(repr, pipeline.language_id(spark, docs, "").collect())) == sorted(map(repr, docs.collect()))


def test_rows_without_id_or_words_stay_and_the_survivor_is_defined(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(None, same, "b"), (None, same, "a"), (3, "", "b"), (3, "", "a"), (3, " \t", "c"), (4, None, "a"), (4, None, "a"), (7, same, "z"), (7, same, "k"), (7, same, "m"), (9, same, "a"), (9, "another text of its own with enough words", "a"), (9, "", "q")]
    docs, made = with_odd_columns(spark, rows)
    for parts in (1, 5):
        kept = [tuple(r) for r in pipeline.near_duplicates(spark, docs.repartition(parts), "").collect()]
        assert sorted(kept, key=repr) == sorted([made[n] for n in (0, 1, 2, 3, 4, 5, 6, 8, 11, 12)], key=repr)


def test_places_are_those_of_the_schedule_of_what_is_kept(spark):
    docs = spark.createDataFrame([(n, f"text {n}", "en", f"s{n % 3 if n % 2 else 0}", 6) for n in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = materialize(pipeline.mix(spark, docs, ""), "kept")
    out = {r.doc_id: r.place for r in pipeline.encoding(spark, kept, "").collect()}
    wanted = {r.doc_id: r.place for r in mixing.mix(kept, 1, 10_000).collect()}
    assert out == wanted and len(set(out.values())) == kept.count()
    slots = sorted(out, key=out.get)
    first = [docs_source for docs_source in ("s%d" % (n % 3 if n % 2 else 0) for n in slots[:90])]
    assert all(abs(first.count(s) - 30) <= 1 for s in ("s0", "s1", "s2"))


def test_empty_documents(spark):
    docs = none(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), name)
    assert docs.count() == 0


def test_run_over_a_folder(spark):
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))


def with_odd_columns(spark, rows):
    """Documents whose own columns have the names that stages might use, and what each row holds of them."""
    names = ["_id", "_key", "_gone", "_maybe", "score", "slot", "lang_pred", "place", "rank", "_doc"]
    made = [(i, t, "en", s, len(t) if t is not None else None, *(f"{c} {n}" for c in names)) for n, (i, t, s) in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)).repartition(3), made


def test_near_duplicates_equal_brute_force(spark):
    rows = [(i, t, "a") for i, t in copies(9)] + [(2, None, "a"), (1, "", "b"), (1, "", "b")]
    docs, made = with_odd_columns(spark, rows)
    kept = [tuple(r) for r in pipeline.near_duplicates(spark, docs, "").collect()]
    least = {(i, n) for i, n, c in brute([(i, t) for i, t, _ in rows], 5, 80) if i == c}
    assert sorted({r[0] for r in kept}) == sorted({i for i, _ in least}) and all(r in made for r in kept)
    wordless = [r for r in rows if not (r[1] or "").strip()]
    assert len(kept) == len(wordless) + len({(i, t) for i, t, _ in rows if (t or "").strip() and any(i == j for j, _ in least)})


def test_secrets_equal_a_loop(spark):
    rng = random.Random(3)
    value = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32))
    common, rows = value(), []
    for n in range(60):
        text = " ".join(rng.choice(["plain words", f"token = {common}", f"secret: {value()}", "password=abc123def", f"{value()} {common}"]) for _ in range(rng.randint(0, 4)))
        rows.append((n, text, f"o{n % 7}/r{n % 11}"))
    rows += [(5, rows[5][1], rows[5][2]), (70, None, None), (71, "", "o1/r")]
    docs, made = with_odd_columns(spark, rows)
    owners: dict[str, set[str]] = {}
    for _, t, s in rows:
        for _, _, _, a, b in secretscan.candidates(t or ""):
            owners.setdefault(t[a:b], set()).add((s or "").split("/")[0])
    wanted = []
    for row in made:
        text, at, parts = row[1], 0, []
        for a, b in sorted((a, b) for _, _, _, a, b in secretscan.candidates(text or "") if len(owners[text[a:b]]) < secretscan.EXAMPLE_OWNERS):
            if a >= at:
                parts += [text[at:a], "[SECRET]"]
            at = max(at, b)
        text = "".join([*parts, text[at:]]) if parts else text
        wanted.append((row[0], text, *row[2:4], len(text) if parts else row[4], *row[5:]))
    assert sorted(map(tuple, pipeline.secrets(spark, docs, "").collect()), key=repr) == sorted(wanted, key=repr)
    assert any(common in (r[1] or "") for r in wanted) and any("[SECRET]" in (r[1] or "") for r in wanted)


def test_mixing_equals_a_loop(spark):
    sizes = {"hot": 300, "mid": 60, "low": 31, None: 1, "": 2}
    rows = [(n, f"text {n}", s) for n, s in enumerate(s for s, k in sizes.items() for _ in range(k))] + [(None, "x", "low"), (7, "text 7", "hot")]
    docs, made = with_odd_columns(spark, rows)
    kept = [tuple(r) for r in pipeline.mix(spark, docs, "").collect()]
    order = sorted((r for r in made if r[3] == "hot"), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[1]))
    rest = [r for r in made if r[3] != "hot"]
    most = len(rest) // 2  # a third of what is kept
    assert len(order) > most and sorted(kept, key=repr) == sorted([*rest, *order[:most]], key=repr)


def test_language_id_keeps_columns_of_any_name(spark):
    docs, made = with_odd_columns(spark, [(n, "the quick brown fox jumps over the lazy dog " * 3, "a") for n in range(30)] + [(40, None, "a"), (41, "12 34", "a")])
    assert sorted(map(tuple, pipeline.language_id(spark, docs, "").collect())) == sorted(made[:30])
