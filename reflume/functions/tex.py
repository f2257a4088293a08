"""LaTeX to running text by a scanner that counts depth: nested arguments and environments within themselves go or stay whole."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\\(begin|end)\{([a-zA-Z]+\*?)\}|\\([a-zA-Z]+)(\{?)|([{}$\\])|[^{}$\\]+")
_BLANKS = re.compile(r"[ \t\n\r]+")
#: Commands whose argument stands for a reference, and headers, in a paper and in one of its sections.
REFERENCES = ("label", "ref", "citep", "citet", "cite")
HEADERS, SECTION_HEADERS = ("section", "subsection"), ("subsection", "textbf")


def stripped(text: str, floats: tuple[str, ...], references: tuple[str, ...], headers: tuple[str, ...], tail: str | None = None) -> str:
    """The text without floats; references are an X, headers end a sentence, other commands leave their argument.

    An environment of ``floats`` that isn't closed stays, without its command; an argument that isn't closed runs to the end. From the
    beginning of ``tail`` on all is dropped.
    """
    if tail is not None:
        text = text.split("\\begin{%s}" % tail, 1)[0]
    out: list[tuple[int, str]] = []  # what is kept, and where it stood
    braces: list[str | None] = []  # what a closing brace becomes; None within an argument that goes
    opened: list[tuple[str, int]] = []
    gone = 0  # open braces that belong to arguments that go
    for m in _TOKEN.finditer(text):
        place, name = m[1], m[2]
        if place and name in floats:
            if place == "begin":
                opened.append((name, len(out)))
                out.append((len(out), f" {name} "))
            elif any(n == name for n, _ in opened):
                while (found := opened.pop())[0] != name:
                    pass
                del out[found[1] :]
            continue
        command, brace, sign = (place or m[3]), (place is not None or bool(m[4])), m[5]
        if sign == "}":
            by = braces.pop() if braces else " "
            if by is None:
                gone -= 1
                by = "" if gone else " X " if ends.pop() == "reference" else " . "
        elif sign:
            by = " "
            if sign == "{":
                braces.append(None if gone else " ")
                gone += bool(gone)
        elif command:
            by = "" if brace else " "
            if place:  # an environment that stays: its name is left as an argument is
                by = name
            elif brace and (gone or command in references or command in headers):
                if not gone:
                    ends = ["reference" if command in references else "header"]
                braces.append(None)
                gone += 1
                continue
            elif brace:
                braces.append("")
        else:
            by = m[0]
        if not gone:
            out.append((len(out), by))
    return _BLANKS.sub(" ", "".join(s for _, s in out)).strip(" ")


def strip(c: Column, floats: list[str], references: tuple[str, ...] = REFERENCES, headers: tuple[str, ...] = HEADERS, tail: str | None = None) -> Column:
    """stripped() of a column; null for nulls."""
    kinds = tuple(floats)

    @F.pandas_udf(T.StringType())
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in columns:
            yield texts.map(lambda t: None if t is None else stripped(t, kinds, references, headers, tail))

    return run(c)
