"""Files round trips, and the text checks on texts written for them."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from reflume import config
from reflume.functions import prose
from reflume.operators import textchecks
from reflume.sources import files


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", one', " spaced "), (2, "two\nlines\r\nand more", None), (3, "comma, é", "x\\y"), (4, "plain", "#")]
    made = spark.createDataFrame(rows, "id int, text string, more string")
    files.write_csv(made.repartition(2), str(tmp_path / "t"))
    files.write_csv(made.repartition(2), str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "t")).collect())) == [(str(i), t, m) for i, t, m in rows]


def test_csv_with_bad_bytes(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes(b"id,name\n1,caf\xe9\n2,\"a\nb\"\n")
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "b.csv")).collect())) == [("1", "caf�"), ("2", "a\nb")]


def test_the_most_complete_set_of_shards_is_read(spark, tmp_path):
    for k, n in ((0, 2), (1, 2), (3, 25)):
        (tmp_path / f"s3_numer_{k}of{n}.csv").write_text(f"month,n\n2020-0{k + 1},{n}\n")
    (tmp_path / "s3_denom_0of9.csv").write_text("month,n\nx,9\n")
    assert sorted(map(tuple, files.read_shards(spark, str(tmp_path), "s3_numer").collect())) == [("2020-01", "2"), ("2020-02", "2")]
    assert {r.file for r in files.listing(spark, str(tmp_path), "*.csv").collect()} == {"s3_numer_0of2.csv", "s3_numer_1of2.csv", "s3_numer_3of25.csv", "s3_denom_0of9.csv"}


def test_json_documents_and_lines(spark, tmp_path):
    one = spark.createDataFrame([(1, None, ["x"])], "a int, b string, c array<string>")
    files.write_json(one, str(tmp_path / "d"))
    assert [tuple(r) for r in files.read_json(spark, str(tmp_path / "d"), one.schema).collect()] == [(1, None, ["x"])]
    with pytest.raises(ValueError):
        files.write_json(one.union(one), str(tmp_path / "e"))
    assert files.read_json(spark, str(tmp_path / "absent"), one.schema).count() == 0
    (tmp_path / "l.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\nnot json\n')
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int, b string").collect()), key=repr) == sorted([(1, "x"), (2, None), (None, None)], key=repr)
    files.write_jsonl(one, str(tmp_path / "w"))
    assert '"b":null' in "".join(r.value for r in spark.read.text(str(tmp_path / "w")).collect())


def test_manifest(spark):
    urls = ["s3://b/works/updated_date=2024-01-02/part_1.parquet", "s3://b/works/updated_date=2023-11-30/part_0.parquet"]
    made = spark.createDataFrame([("2026-06-26", 5, [(u, 2) for u in urls])], files.MANIFEST)
    assert [tuple(r) for r in files.manifest_files(made).orderBy("place").collect()] == [
        ("2026-06-26", "b/works/updated_date=2023-11-30/part_0.parquet", "part_0.parquet@2023-11-30", 0, 2),
        ("2026-06-26", "b/works/updated_date=2024-01-02/part_1.parquet", "part_1.parquet@2024-01-02", 1, 2),
    ]


def test_report(spark):
    values = spark.createDataFrame([("b", "2"), ("a", None), ("c", "x" * 400)], "name string, value string")
    assert [r.line for r in files.report(values, "T").orderBy("n").collect()] == ["# T", "", f"- `a`: {files.MISSING}", "- `b`: 2", "- `c`: " + "x" * 300, "", "## Still missing: 1", "- a"]


def texts(spark, *rows):
    return spark.createDataFrame([(n, t) for n, t in enumerate(rows)], "doc_id int, text string")


def test_latex_and_sections(spark):
    body = " ".join(f"w{i}" for i in range(70))
    tex = r"\title{x}\section{One}\begin{figure}gone\end{figure} See \cite{k} \emph{it} {a} $b$. " + body + r"\section{Short}few words\section{Two}\subsection{s} " + body
    row = texts(spark, tex).select(prose.section_map(F.col("text"), config.FLOATS).alias("s")).first()
    assert [(s.n, s.title) for s in row.s] == [(0, "One"), (2, "Two")]
    assert row.s[0].body == "See X it a b . " + body and row.s[1].body == ". " + body


def test_paragraphs_and_deviation(spark):
    long_ = " ".join(["word"] * 30)
    row = texts(spark, f"{long_}\n \n{long_} more\n\nshort").select(prose.paragraphs(F.col("text")).alias("p"), prose.deviation(F.array(*(F.lit(float(x)) for x in (3, 9, 9, 1)))).alias("d"), prose.deviation(F.array().cast("array<double>")).alias("e")).first()
    assert row.p == [30, 31] and abs(row.d - statistics.pstdev([3, 9, 9, 1])) < 1e-12 and row.e is None


def test_words_with_an_exempt_context(spark):
    docs = texts(spark, "Robust standard errors. The method is robust. A robust idea, ROBUST indeed; cutting-edge, delves.", "x" * 50 + " robust", "", None)
    found = {(r.doc_id, r.word): r.n for r in textchecks.word_counts(docs, ["robust", "delve", "cutting-edge"]).collect()}
    assert found[0, "cutting-edge"] == 1 and found[0, "delve"] == 0 and found[1, "robust"] == 1 and found[2, "robust"] == 0
    assert found[0, "robust"] == sum(not any(p in ctx.lower() for p in ("robust standard", "is robust")) for ctx in contexts("Robust standard errors. The method is robust. A robust idea, ROBUST indeed; cutting-edge, delves."))


def contexts(text):
    at, low = -1, text.lower()
    while (at := low.find("robust", at + 1)) >= 0:
        yield text[max(0, at - 45) : at + 25]


def test_patterns_claims_hedges_adverbs_passives(spark):
    docs = texts(spark, "It serves as proof. Not only here\nbut also there.", "Rain causes floods. Rain may cause floods. It was due to p = 0.01 luck.", "It may possibly often fail here. It appears to work.", "They quickly and only slowly were being taken away; naïvely said.")
    hits = {r.doc_id: r for r in textchecks.pattern_hits(docs, config.PATTERNS).collect()}
    assert hits[0].serves_as and hits[0].not_only_but_also and not hits[1].serves_as
    s = prose.sentences(F.col("text"))
    row = docs.select(F.size(F.filter(s, lambda x: prose.has(x, config.CAUSAL) & ~prose.has(x, config.CALM))).alias("bare"), F.size(F.filter(s, lambda x: prose.hits(x, config.HEDGE_STACK) >= 3)).alias("stacked"), prose.adverbs(F.col("text"), config.ADVERB, config.NO_ADVERBS).alias("adverbs"), prose.hits(F.col("text"), config.PASSIVE).alias("passive")).collect()
    assert (row[1].bare, row[2].stacked, row[3].adverbs, row[3].passive) == (1, 1, 3, 1)


def test_section_limits(spark):
    even = "One two three four five six seven. " * 20
    mixed = "It was said and is taken and were given and are eaten and be written and been hidden and is opened there. Only five words are here now. " + " ".join(["long"] * 60) + " end. The results are in plainly sadly badly gladly."
    docs = spark.createDataFrame([("even", even), ("mixed", mixed)], "title string, body string")
    found = {r.title: r for r in textchecks.section_checks(docs, spark.createDataFrame([(9.0,)], "c_med double")).collect()}
    assert (found["even"].median_ok, found["even"].sd_ok, found["even"].max_ok, found["even"].passives_ok, found["even"].vague_ok) == (True, False, True, True, True)
    assert (found["mixed"].sd_ok, found["mixed"].max_ok, found["mixed"].adverbs_ok, found["mixed"].passives_ok, found["mixed"].vague_ok) == (True, False, False, False, False)


def test_style_spread(spark):
    corpus = spark.createDataFrame([(1, 0.0, 5.0), (2, 2.0, 5.0), (3, 4.0, 5.0)], "id int, a double, b double")
    asked = spark.createDataFrame([(7, 2.1, 5.0), (8, 40.0, 5.0), (9, 3.0, 5.0)], "id int, a double, b double")
    found = {r.id: r for r in textchecks.style_distances(asked, corpus, ["a", "b"]).collect()}
    sd = math.sqrt(8 / 3)
    assert found[7].nearest_id == 2 and abs(found[7].nearest - 0.1 / sd) < 1e-6 and found[7].inside and not found[7].no_clone
    assert not found[8].inside and found[8].no_clone and found[8].nearest_id == 3
    assert found[9].nearest_id == 2 and abs(found[9].centroid - 1 / sd) < 1e-6


def test_provenance_and_rubric(spark):
    docs = texts(spark, "The ratio was 0.878 of 1,645 papers.", "Nothing here.")
    results = spark.createDataFrame([("ratio", "0.878"), ("n", "1,645"), ("other", "7.7")], "name string, said string")
    found = {(r.doc_id, r.name) for r in textchecks.provenance(docs, results).collect() if r.found}
    assert found == {(0, "ratio"), (0, "n")}
    many = spark.createDataFrame([(str(n), f"{n}") for n in range(2500)], "name string, said string")
    rows = textchecks.provenance(docs, many, at_once=100).collect()
    assert len(rows) == 5000 and {int(r.name) for r in rows if r.found} == {n for n in range(2500) if str(n) in "The ratio was 0.878 of 1,645 papers."}
    row = spark.range(1).select(textchecks.rubric([(F.lit(12.0), 10, 0.5), (F.lit(4), 10, 0.25)]).alias("s")).first()
    assert row.s == 6.0
