"""Column functions over prose: words, sentences, and counts within them, all within a row.

Words for counting are runs of a-z after lower-casing; sentence lengths count what stands between white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\r]+"
#: Accented Latin letters; patterns see each as an "x", so that every engine takes it for part of a word.
ACCENTED = "[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(c), "[^a-z]+"), "")


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, BLANKS), "")


def sentences(c: Column, least: int = 3) -> Column:
    """Text between sentence ends, of at least so many words."""
    parts = F.split(F.regexp_replace(c, r"([.!?])[ \t\n\r]+", "$1\u0001"), "\u0001")
    return F.filter(parts, lambda s: F.size(words(s)) >= least)


def lengths(c: Column, least: int = 4) -> Column:
    return F.transform(sentences(c, least), lambda s: F.size(words(s)).cast("double"))


def paragraphs(c: Column, least: int = 25) -> Column:
    """Word counts of paragraphs, which blank lines part, of at least so many words."""
    return F.filter(F.transform(F.split(c, r"\n[ \t\r\n]*\n"), lambda p: F.size(words(p)).cast("double")), lambda n: n >= least)


def plain_letters(c: Column) -> Column:
    return F.regexp_replace(c, ACCENTED, "x")


def hits(c: Column, pattern: str) -> Column:
    """How often a pattern occurs, whatever the case."""
    return F.regexp_count(plain_letters(c), F.lit(f"(?i){pattern}"))


def has(c: Column, pattern: str) -> Column:
    return F.rlike(plain_letters(c), F.lit(f"(?i){pattern}"))


def adverbs(c: Column, pattern: str, but: list[str]) -> Column:
    """Matches of the pattern in lower case that aren't listed."""
    found = F.regexp_extract_all(F.lower(plain_letters(c)), F.lit(pattern), 0)
    return F.size(F.filter(found, lambda w: ~w.isin(but)))


def strip_latex(c: Column, floats: list[str]) -> Column:
    """LaTeX to running text: floats go, references are an X, headers end a sentence, other commands leave their argument."""
    for name in floats:
        c = F.regexp_replace(c, r"(?s)\\begin\{%s\}.*?\\end\{%s\}" % (name, name), "")
    c = F.regexp_replace(c, r"\\(label|ref|citep|citet|cite)\{[^}]*\}", " X ")
    c = F.regexp_replace(c, r"\\(sub)?section\{[^}]*\}", " . ")
    c = F.regexp_replace(c, r"\\[a-zA-Z]+\{([^{}]*)\}", "$1")
    c = F.regexp_replace(c, r"\\[a-zA-Z]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[{}$\\]", " "), BLANKS, " "))


def section_map(c: Column, floats: list[str], least: int = 61) -> Column:
    """(n, title, body) of each section of a LaTeX text whose body has at least so many words; sections of one title stay apart."""
    titles = F.regexp_extract_all(c, F.lit(r"\\section\{([^}]+)\}"), 1)
    bodies = F.slice(F.split(c, r"\\section\{[^}]+\}", -1), 2, F.size(titles))
    each = F.zip_with(titles, F.transform(bodies, lambda b, n: F.struct(n.alias("n"), strip_latex(b, floats).alias("body"))), lambda t, b: F.struct(b["n"].alias("n"), t.alias("title"), b["body"].alias("body")))
    return F.filter(each, lambda s: F.size(words(s["body"])) >= least)


def strip_markup(c: Column) -> Column:
    """HTML to running text: scripts, styles and tags go, four entities are written out, blanks are folded."""
    t = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(t, BLANKS, " "))


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))


def deviation(a: Column) -> Column:
    """Population standard deviation, in one pass over the array."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(state: Column, x: Column) -> Column:
        n, apart = state["n"] + 1, x - state["mean"]
        centre = state["mean"] + apart / n
        return F.struct(n.alias("n"), centre.alias("mean"), (state["squares"] + apart * (x - centre)).alias("squares"))

    return F.aggregate(a, start, step, lambda state: F.sqrt(state["squares"] / F.nullif(state["n"], F.lit(0.0))))


def median(a: Column) -> Column:
    s, n = F.sort_array(a), F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def share(a: Column, test) -> Column:
    return F.size(F.filter(a, test)) / F.nullif(F.size(a), F.lit(0))


def count_in(a: Column, listed: list[str]) -> Column:
    return F.size(F.filter(a, lambda w: w.isin(listed)))
