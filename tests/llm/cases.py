"""Documents with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

LONG = " ".join(f"word{i % 977} the of" for i in range(12_000))
PROSE = "The quick brown fox jumps over the lazy dog while we watch it from the old stone bridge near the river. "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, score string, ids string, key int, _place int, row int"


def documents(spark):
    texts = [
        (0, PROSE * 4, "en", "a/x"),
        (1, PROSE * 4, "en", "a/x"),
        (1, PROSE * 4, "en", "a/x"),
        (2, PROSE * 4 + "One more ending here.", "en", "b/y"),
        (3, "", "en", None),
        (4, None, None, None),
        (5, "   \n\t ", "en", ""),
        (6, LONG, "en", "a/x"),
        (7, "Der schnelle Fuchs springt über den faulen Hund und läuft dann weit durch den dunklen Wald.", "de", "c"),
        (8, "12345 67890 !!! 🙂", None, "c"),
        (None, "no id here", "en", "c"),
        (-9, "é" * 500 + "\u0000 Ünïcödé <|endoftext|> token = abcdef123456", "fr", "c"),
        (10, "a", "en", "c"),
    ]
    rows = [(i, t, g, s, len(t) if t is not None else None, n, "x", "y", n, n, n) for n, (i, t, g, s) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
