"""Column functions: identifiers, dates, inverted indexes, marker scores. Nulls give nulls unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: DOI prefixes, in the order in which each is taken off once; characters around a vocabulary's words.
DOI_PREFIXES = ["https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:"]
AROUND_WORDS = ' ",:{}[]().;'


def without_prefix(c: Column, size: int = 21) -> Column:
    return F.substring(c, size + 1, 2147483647)


def ascii_bounds(pattern: str) -> str:
    """A pattern whose word bounds part ASCII words from all else, as SQL's do; Java's own take other letters for parts of words too."""
    within, before = "[0-9A-Za-z_]", "(?<![0-9A-Za-z_])"
    return pattern.replace(r"\b", f"(?:{before}(?={within})|(?<={within})(?!{within}))")


def short_id(c: Column) -> Column:
    return F.substring_index(F.nullif(c, F.lit("")), "/", -1)


def norm_doi(c: Column) -> Column:
    """A DOI as a key: lower case, without resolver prefix, tracking suffix or closing punctuation; nothing left gives null."""
    d = F.lower(F.trim(c))
    for prefix in DOI_PREFIXES:  # a pattern each, so that the column stands in the expression once
        d = F.regexp_replace(d, "^" + prefix.replace(".", "\\."), "")
    d = F.substring_index(F.substring_index(d, "?", 1), "#", 1)
    return F.nullif(F.rtrim(d, F.lit(".,;)")), F.lit(""))


def parse_date(c: Column) -> Column:
    """The first word as a date, month first or ISO; anything else gives null."""
    word = F.split(F.trim(c), " ")[0]
    return F.coalesce(F.try_to_date(word, "M/d/yyyy"), F.try_to_date(word, "yyyy-MM-dd"))


def eligible_from(c: Column, months: int) -> Column:
    return F.add_months(c, months)


def month_of(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def epoch_days(c: Column) -> Column:
    return F.unix_date(c).cast("long")


def stable_fraction(c: Column) -> Column:
    """A hash of the text from 0 to 1, both attainable."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))


def named(c: Column) -> Column:
    """Null and empty names are Unknown."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))


def inverted_text(c: Column) -> Column:
    """The text of a map from words to their positions; of two words at one position the later entry wins. Null and empty give ''."""
    placed = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("at"), e["key"].alias("word")))))
    numbered = F.transform(placed, lambda p, n: F.struct(p["at"].alias("at"), (-n).alias("n"), p["word"].alias("word")))
    ordered = F.sort_array(numbered)
    beside = F.zip_with(ordered, F.concat(F.array(F.lit(None)), ordered), lambda p, q: F.when(q.isNull() | (q["at"] != p["at"]), p["word"]))
    return F.coalesce(F.array_join(beside, " "), F.lit(""))  # nulls, of positions that have a word already, aren't joined


def inverted_index(words: Column) -> Column:
    """A map from each of an array's words to its positions, worked out within the row; null gives null."""

    def grouped(placed: Column) -> Column:  # by word, then position
        begins = F.array_compact(F.transform(placed, lambda p, i: F.when((i == 0) | (F.get(placed, i - 1)["word"] != p["word"]), i)))
        return _with(begins, lambda b: F.transform(b, lambda i, n: F.struct(F.get(placed, i)["word"], F.transform(F.slice(placed, i + 1, F.coalesce(F.get(b, n + 1), F.size(placed)) - i), lambda p: p["at"]))))

    return F.map_from_entries(_with(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at")))), grouped))


def _with(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is worked out once, also where f has it within functions of elements."""
    return F.transform(F.array(c), f)[0]


def vocabulary(c: Column) -> Column:
    """Distinct lower-case words of a text, or keys if it is a JSON object. Null gives an empty array."""
    keys = F.when(F.ltrim(c).startswith("{"), F.map_keys(F.from_json(c, "map<string,string>")))
    found = F.coalesce(keys, F.split(F.trim(c), r"\s+"))
    return F.coalesce(F.array_distinct(F.transform(found, lambda w: F.lower(F.btrim(w, F.lit(AROUND_WORDS))))), F.array().cast("array<string>"))


def marker_score(c: Column, markers: list[str]) -> Column:
    """How many of the markers the vocabulary has."""
    return F.size(F.array_intersect(vocabulary(c), F.array(*map(F.lit, markers)))).cast("long")


def rate(events: Column, of: Column, per: float = 10_000.0) -> Column:
    return F.when(of > 0, events / of * per)


def log_distance(refs_a: Column, refs_b: Column, cites_a: Column, cites_b: Column) -> Column:
    return F.abs(F.log1p(refs_a) - F.log1p(refs_b)) + 0.5 * F.abs(F.log1p(cites_a) - F.log1p(cites_b))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def clean_reason(c: Column) -> Column:
    return F.btrim(c, F.lit(";+ "))
