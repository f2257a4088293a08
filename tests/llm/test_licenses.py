import re

from reflume.llm import licenses

from .cases import none

TEXTS = [
    (1, "Released under the MIT License. And again: UNDER THE MIT LICENSE"),
    (2, "Licensed under the Apache License, Version 2.0."),
    (3, "cc-by-nc cc by nc cc by nc nc"),
    (4, "under the mit licence"),
    (5, None),
    (6, ""),
    (7, "permission is hereby granted, free of charge, to any other person obtaining a copy of this software and associated documentation files (the software), to deal in the software without limits"),
    (1, "Released under the MIT License. And again: UNDER THE MIT LICENSE"),
    (None, "under the mit license é under the mit license"),
    (9, "x " * 50_000 + "apache license version 2"),
]


def places(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_base_equals_a_loop(spark):
    rows = licenses.scan(spark.createDataFrame(TEXTS, "doc_id long, text string")).collect()
    found = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=repr)
    assert found == sorted(((i, *places(t)) for i, t in TEXTS), key=repr)
    assert all(set(r.base_labels.split(",")) <= {*r.labels.split(","), ""} and 0 <= r.score <= 1 for r in rows)


def test_notices_survive_changed_words(spark):
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(TEXTS, "doc_id long, text string")).collect()}
    assert rows[7].labels == "mit" and rows[7].n_base == 0 and 0.6 <= rows[7].score < 1
    assert rows[4].labels == "" and rows[4].score == 0


def test_empty_table(spark):
    assert licenses.scan(none(spark)).count() == 0
