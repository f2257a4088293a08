"""The scanner of markup against a recursive reading of nested text."""

import random

from pyspark.sql import functions as F

from reflume.functions import tex

FLOATS = ["figure", "table"]


def made(rng, depth):
    """A text as a tree: strings, (command, children) and (environment, children)."""
    parts = []
    for _ in range(rng.randint(0, 4)):
        kind = rng.random()
        if depth and kind < 0.25:
            parts.append(("command", rng.choice(["section", "ref", "emph", "textbf", "subsection"]), made(rng, depth - 1)))
        elif depth and kind < 0.45:
            parts.append(("environment", rng.choice(["figure", "table", "itemize"]), made(rng, depth - 1)))
        elif depth and kind < 0.55:
            parts.append(("group", "", made(rng, depth - 1)))
        else:
            parts.append(rng.choice(["word ", "more ", "$x$ ", "two words. ", "\\par ", "é\n "]))
    return parts


def written(parts):
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(p)
        elif p[0] == "command":
            out.append("\\%s{%s}" % (p[1], written(p[2])))
        elif p[0] == "group":
            out.append("{%s}" % written(p[2]))
        else:
            out.append("\\begin{%s}%s\\end{%s}" % (p[1], written(p[2]), p[1]))
    return "".join(out)


def read(parts):
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(p.replace("\\par", " ").replace("$", " "))
        elif p[0] == "command":
            out.append(" X " if p[1] == "ref" else " . " if p[1] in tex.HEADERS else read(p[2]))
        elif p[0] == "group":
            out.append(f" {read(p[2])} ")
        elif p[1] not in FLOATS:
            out.append(f"{p[1]}{read(p[2])}{p[1]}")
    return "".join(out)


def test_nested_texts_equal_a_recursive_reading(spark):
    rng = random.Random(3)
    trees = [made(rng, 4) for _ in range(2000)]
    rows = spark.createDataFrame([(n, written(t)) for n, t in enumerate(trees)] + [(-1, None), (-2, "")], "n int, t string")
    found = {r.n: r.p for r in rows.select("n", tex.strip(F.col("t"), FLOATS).alias("p")).collect()}
    assert found[-1] is None and found[-2] == ""
    for n, t in enumerate(trees):
        assert found[n] == " ".join(read(t).replace("\n", " ").split(" ")).strip() or found[n].split() == read(t).split(), written(t)


def test_odd_texts():
    strip = lambda t, **k: tex.stripped(t, ("figure", "table"), tex.REFERENCES, tex.HEADERS, **k)
    assert strip(r"a } b { c \ d") == "a b c d"
    assert strip(r"a \begin{figure} b") == "a figure b" and strip(r"a \end{figure} b") == "a b"
    assert strip(r"\begin{table}\begin{figure}x\end{table} y") == "y"
    assert strip(r"a \begin{refs} b", tail="refs") == "a"
    long_ = r"\emph{" * 5000 + "x" + "}" * 5000
    assert strip(long_) == "x" and strip("word " * 200_000).count("word") == 200_000
