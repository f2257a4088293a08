import math
import random
import zlib

from reflume.llm import langid

from .cases import documents, none

WORDS = {"aa": ["kilo", "lamu", "miko", "nalo"], "bb": ["stref", "grunt", "plosk", "brend"], "cc": ["été", "çava", "naïf", "où"]}


def labelled(spark, n=300):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 60))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def phrases(text, of):
    """Longest matches with a text's substrings, one after another."""
    count = at = 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in of:
            size += 1
        at += max(1, size - 1)
        count += 1
    return count


def test_parse_equals_substring_search():
    rng = random.Random(4)
    of = "".join(rng.choice("abc ") for _ in range(400))
    own = langid.Parser((("x", of),))
    for _ in range(60):
        text = langid.plain("".join(rng.choice("abcd ") for _ in range(rng.randint(1, 200))))
        if text:
            counts, sizes = own.phrases([text])
            assert sizes[0] == len(text) and counts[0, 0] == phrases(text, langid.plain(of))


def test_phrases_over_segments_equal_substring_search(monkeypatch):
    """Segments that come into step late or never, in texts of one letter and of many."""
    rng = random.Random(9)
    of = ["".join(rng.choice("abc ") for _ in range(300)) + " aaaaaaa", "".join(rng.choice("cdé ") for _ in range(200)), "ok"]
    own = langid.Parser(tuple((str(n), t) for n, t in enumerate(of)))
    texts = [langid.plain("".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))) for letters in ["abc ", "a", "abcdé ", "zz a", "aab"] * 8]
    for segment, part in ((8, 8), (64, 16), (512, 64)):
        monkeypatch.setattr(langid, "SEGMENT", segment)
        monkeypatch.setattr(langid, "PART", part)
        counts, sizes = own.phrases(texts)
        assert sizes.tolist() == [len(t) for t in texts]
        for row, text in zip(counts, of, strict=True):
            assert row.tolist() == [phrases(t, langid.plain(text)) for t in texts]


def test_held_out_rows_are_recognised_and_not_learned_from(spark):
    docs = labelled(spark)
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert sum(found[i].lang_pred == truth[i] for i in truth if found[i].held_out) >= 0.95 * sum(r.held_out for r in found.values())
    flipped = docs.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 5 = 0 then 'zz' else lang end as lang")
    assert langid.sample(docs) == langid.sample(flipped)


def test_odd_rows(spark):
    docs = documents(spark)
    found = langid.identify(docs).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in found if r.doc_id in (3, 4, 5, 8)} == {"und"}
    assert langid.identify(none(spark)).count() == 0 and langid.identify(docs.where("lang is null")).count() == 2
    kept = langid.accept(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({3, 4, 5, 8})


def test_letters_at_random_are_rejected(spark):
    rng = random.Random(5)
    noise = spark.createDataFrame([(1000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)), None), (1001, "語" * 50, None)], "doc_id long, text string, lang string")
    docs = labelled(spark)
    kept = langid.accept(docs.union(noise))
    assert kept.count() == docs.count()


def test_long_texts_are_learned_from_and_tiny_samples_win_nothing(spark):
    rng = random.Random(6)
    long = [(10_000 + i, "7" * 2000 + " " + " ".join(rng.choice(["дом", "река", "поле"]) for _ in range(900)), "ru") for i in range(40)]
    tiny = [(i, "ok", "zz") for i in range(20_000, 20_010)]
    docs = labelled(spark).union(spark.createDataFrame(long + tiny, "doc_id long, text string, lang string"))
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(len(t) <= 60 * (langid.SAMPLE_CHARS + 1) for _, t in langid.sample(docs))
    assert all(found[i] == "ru" for i, _, _ in long)
    assert sum(found[i] == truth[i] for i in range(300)) >= 0.95 * 300


def test_texts_in_two_scripts_are_kept(spark):
    rng = random.Random(7)
    of = {"en": "abcdefghijklmnoprstuwy", "ru": "абвгдежзиклмнопрстуыья"}
    lexicon = {g: ["".join(rng.choice(a) for _ in range(rng.randint(3, 9))) for _ in range(2000)] for g, a in of.items()}
    said = lambda g, n: " ".join(rng.choice(lexicon[g]) for _ in range(n))
    rows = [(i, said(g, 200), g) for i, g in enumerate(["en", "ru"] * 80)]
    halves = [(1000, said("en", 300) + " " + said("ru", 300)), (1001, " ".join(said(g, 15) for g in ["en", "ru"] * 20)), (1002, "語" * 500 + " " + said("en", 60)), (1003, "語" * 500)]
    docs = spark.createDataFrame(rows + [(i, t, None) for i, t in halves], "doc_id long, text string, lang string")
    assert {r.doc_id for r in langid.accept(docs).collect()} == {i for i, _, _ in rows} | {1000, 1001, 1002}


def test_the_query_equals_a_plain_parse(spark, monkeypatch):
    """lang_pred and score of every row, from substring search; text that is written over the columns' names stays."""
    docs = labelled(spark, 60).union(spark.createDataFrame([(900, None, None), (901, " 12 ", "aa"), (902, "kilo été 語 stref", None), (902, "kilo été 語 stref", None)], "doc_id long, text string, lang string"))
    learned = [(g, langid.plain(t)) for g, t in langid.sample(docs)]
    wanted = []
    for r in docs.collect():
        text = langid.plain(r.text or "")
        if not text:
            wanted.append((r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 5 == 0, "und", 0.0))
            continue
        rates = []
        for g, of in learned:
            bits = math.log2(len(of) + 2)
            strange = sum(c != " " and c not in of for c in text)
            rates.append(((phrases(text, of) * bits + strange * max(0, langid.LETTER_BITS - bits)) / len(text), g))
        low, second = sorted(rates)[:2]
        wanted.append((r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 5 == 0, low[1], round(1 - low[0] / second[0], 9)))
    found = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in langid.identify(docs).collect()]
    assert sorted(found) == sorted(wanted)
    clashing = docs.selectExpr("*", "'s' as score", "'b' as bits", "'l' as lang_pred", "'k' as known", "'d' as _doc", "'f' as _found")
    kept = langid.accept(clashing).collect()
    assert len(kept) >= 60 and all((r.score, r.bits, r.lang_pred, r.known, r._doc, r._found) == tuple("sblkdf") for r in kept)
