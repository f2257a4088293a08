"""Queries on prose: markup, sentences, profiles, bands, word and pattern checks, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions import prose, tex
from ..operators import textchecks
from ..sources.standins import table
from .queries import query

#: Words that do occur in the test folders' texts, before the listed ones.
LISTED = ["the", "of", *config.BANNED]
PATTERNS = [("digits", "[0-9]{4}"), ("mail", "[a-z]+@[a-z0-9.]+"), *config.PATTERNS]
_SPLIT = r"regexp_split_to_array({}, '[ \t\n\r]+')"
_WORDS = "list_filter(" + _SPLIT + ", lambda w: w <> '')"


def _sent(least: int, text: str = "text") -> str:
    return rf"list_filter(string_split(regexp_replace({text}, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: len(" + _WORDS.format("s") + f") >= {least})"


def _plain(text: str) -> str:
    return f"regexp_replace({text}, '{prose.ACCENTED}', 'x', 'g')"


def _hits(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({_plain(text)}, '(?i){pattern}'))"


def _adverbs(text: str, but: list[str]) -> str:
    return f"len(list_filter(regexp_extract_all(lower({_plain(text)}), '{config.ADVERB}'), lambda x: NOT list_contains({but!r}, x)))"


def _base(source: str, key: str) -> str:
    """Sentences of four words and more, their lengths and words of a table, for DuckDB."""
    return f"""SELECT {key} AS id, text, s, list_transform(s, lambda x: len({_WORDS.format('x')})::DOUBLE) AS l, len({_WORDS.format('text')}) AS nw,
list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda w: w <> '') AS w FROM (SELECT *, {_sent(4)} AS s FROM {source})"""


def _profile(base: str) -> str:
    return f"""SELECT id, len(l) AS n_sentences, list_median(l) AS median_len, list_stddev_pop(l) AS sd_len, list_max(l) AS max_len,
len(list_filter(l, lambda n: n < 13)) / nullif(len(l), 0)::DOUBLE AS short_share, len(list_filter(l, lambda n: n > 34)) / nullif(len(l), 0)::DOUBLE AS long_share,
len(list_filter(w, lambda x: list_contains({config.PROFILE_HEDGES!r}, lower(x)))) / (nullif(nw, 0) / 100::DOUBLE) AS hedges, len(list_filter(w, lambda x: x = 'We')) / (nullif(nw, 0) / 100::DOUBLE) AS we,
nw::DOUBLE AS n_words, len(regexp_extract_all(text, '[0-9]')) / (nullif(nw, 0) / 100::DOUBLE) AS digits FROM ({base})"""


DOCS = f"WITH b AS ({_base('documents', 'doc_id')}), p AS ({_profile('SELECT * FROM b')}), cb AS ({_base('benchmark', 'item_id')}), c AS ({_profile('SELECT * FROM cb')})\n"
NAMES = textchecks.PROFILE
_STRIP = "text"
for _name in config.FLOATS:
    _STRIP = rf"regexp_replace({_STRIP}, '(?s)\\begin\{{{_name}\}}.*?\\end\{{{_name}\}}', '', 'g')"
for _pattern, _by in ((r"\\(label|ref|citep|citet|cite)\{[^}]*\}", " X "), (r"\\(sub)?section\{[^}]*\}", " . "), (r"\\[a-zA-Z]+\{([^{}]*)\}", r"\1"), (r"\\[a-zA-Z]+", " "), (r"[{}$\\]", " "), (r"[ \t\n\r]+", " ")):
    _STRIP = f"regexp_replace({_STRIP}, '{_pattern}', '{_by}', 'g')"
_STRIP = f"trim({_STRIP})"
#: Conversations as papers, a turn a section with a subsection, a reference and a command in it.
PAPERS = r"""papers AS (SELECT conv_id, string_agg('\section{' || role || ' ' || turn || '}\subsection{a}\label{b} ' || text || ' \emph{last} words', chr(10) ORDER BY turn) AS tex FROM conversations GROUP BY 1)"""
SECTIONS = rf"""{PAPERS}, parts AS (SELECT conv_id, unnest(range(0, len(t))) AS n, unnest(t) AS title, unnest(list_slice(b, 2, len(b))) AS text
FROM (SELECT conv_id, regexp_extract_all(tex, '\\section\{{([^}}]+)\}}', 1) AS t, string_split_regex(tex, '\\section\{{[^}}]+\}}') AS b FROM papers)),
sections AS (SELECT conv_id, n, title, body FROM (SELECT *, {_STRIP} AS body FROM parts) WHERE len({_WORDS.format('body')}) > 60)
"""


def papers(spark: SparkSession, d: str) -> DataFrame:
    turn = F.concat(F.lit("\\section{"), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("}\\subsection{a}\\label{b} "), "text", F.lit(" \\emph{last} words"))
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("tex")))).alias("t"))
    return turns.select("conv_id", F.array_join(F.col("t.tex"), "\n").alias("tex"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    found = papers(spark, d).select("conv_id", F.explode(prose.section_map(F.col("tex"), config.FLOATS)).alias("s"))
    return found.select("conv_id", F.col("s.n").cast("long").alias("n"), "s.title", "s.body")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def profiles(spark: SparkSession, d: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return textchecks.profile(table(spark, d, name).select(F.col(key).alias("id"), "text")).drop("text")


def rounded(d: DataFrame, names: list[str]) -> DataFrame:
    return d.select(*(F.round(c, 6).alias(c) if c in names else F.col(c) for c in d.columns))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages""")
def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", prose.strip_markup(F.col("html")).alias("text"))


@query(f"SELECT doc_id, unnest(range(0, len(s))) AS n, unnest(s) AS sentence FROM (SELECT doc_id, {_sent(3)} AS s FROM documents)")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.posexplode(prose.sentences(F.col("text"))).alias("n", "sentence")).withColumn("n", F.col("n").cast("long"))


@query(f"WITH {PAPERS} SELECT conv_id, {_STRIP.replace('(text,', '(tex,')} AS prose FROM papers")
def strip_latex(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).select("conv_id", prose.strip_latex(F.col("tex"), config.FLOATS).alias("prose"))


def _scanned(steps: list[tuple[str, str]], tail: bool = False) -> str:
    """The scanner's result for texts without nesting, as a chain of patterns for DuckDB."""
    text = r"regexp_replace(tex, '(?s)\\begin\{thebibliography\}.*', '')" if tail else "tex"
    for name in config.FLOATS:
        text = rf"regexp_replace({text}, '(?s)\\begin\{{{name}\}}.*?\\end\{{{name}\}}', '', 'g')"
    for pattern, by in (*steps, (r"\\[a-zA-Z]+\{([^{}]*)\}", r"\1"), (r"\\[a-zA-Z]+", " "), (r"[{}$\\]", " "), (r"[ \t\n\r]+", " ")):
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return f"SELECT conv_id, trim({text}) AS prose FROM marked"


#: Papers with figures, references and a bibliography.
MARKED = PAPERS + r""", marked AS (SELECT conv_id, '\textbf{Start.} \begin{figure} seen \ref{f} \end{figure} ' || tex || ' \citep{x1} \begin{itemize} one \end{itemize} $y$ {z} \begin{thebibliography} all of it \end{thebibliography}' AS tex FROM papers)
"""


def marked(spark: SparkSession, d: str) -> DataFrame:
    before, after = r"\textbf{Start.} \begin{figure} seen \ref{f} \end{figure} ", r" \citep{x1} \begin{itemize} one \end{itemize} $y$ {z} \begin{thebibliography} all of it \end{thebibliography}"
    return papers(spark, d).select("conv_id", F.concat(F.lit(before), F.col("tex"), F.lit(after)).alias("tex"))


@query(f"WITH {MARKED} " + _scanned([(r"\\(label|ref|citep|citet|cite)\{[^}]*\}", " X "), (r"\\(sub)?section\{[^}]*\}", " . ")]))
def strip_paper(spark: SparkSession, d: str) -> DataFrame:
    """Papers to prose by the scanner that counts depth."""
    return marked(spark, d).select("conv_id", tex.strip(F.col("tex"), config.FLOATS).alias("prose"))


@query(f"WITH {MARKED} " + _scanned([(r"\\(section|subsection)\{[^}]*\}", " . ")], tail=True))
def strip_manuscript(spark: SparkSession, d: str) -> DataFrame:
    """The same without what follows the bibliography's beginning, references left as words."""
    return marked(spark, d).select("conv_id", tex.strip(F.col("tex"), config.FLOATS, (), tex.HEADERS, "thebibliography").alias("prose"))


@query(f"WITH {MARKED} " + _scanned([(r"\\(label|ref|citep|citet|cite)\{[^}]*\}", " X "), (r"\\subsection\{[^}]*\}", " . "), (r"\\textbf\{[^}]*\}", " . ")]))
def strip_section_text(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of sections, whose bold run-in headers end a sentence."""
    return marked(spark, d).select("conv_id", tex.strip(F.col("tex"), config.FLOATS, tex.REFERENCES, tex.SECTION_HEADERS).alias("prose"))


@query(f"WITH {SECTIONS} SELECT * FROM sections")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    return sections(spark, d)


_BLOCKS = r"string_split_regex(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), '\n[ \t\r\n]*\n')"


@query(f"SELECT doc_id, len(p) AS n, list_max(p) AS longest, round(list_stddev_pop(p), 6) AS sd FROM (SELECT doc_id, list_filter(list_transform({_BLOCKS}, lambda x: len({_WORDS.format('x')})::DOUBLE), lambda n: n >= 25) AS p FROM documents)")
def paragraph_stats(spark: SparkSession, d: str) -> DataFrame:
    p, text = F.col("p"), F.replace(F.col("text"), F.lit(". "), F.lit(".\n \n"))  # a blank line after each sentence, as the texts have none
    return documents(spark, d).withColumn("p", prose.paragraphs(text)).select("doc_id", F.size(p).cast("long").alias("n"), F.array_max(p).alias("longest"), F.round(prose.deviation(p), 6).alias("sd"))


@query(DOCS + "SELECT id, n_sentences, " + ", ".join(f"round({n}, 6) AS {n}" for n in textchecks.PROFILE) + " FROM p")
def prose_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profiles(spark, d), textchecks.PROFILE).drop("n_words", "digits")


def _inside(names: list[str], low: float, high: float) -> str:
    each = " + ".join(f"CASE WHEN round({n}, 6) BETWEEN {n}_lo * {low}::DOUBLE AND {n}_hi * {high}::DOUBLE THEN 1 ELSE 0 END" for n in names)
    return DOCS + f"SELECT id, ({each})::BIGINT AS n_inside FROM p, (SELECT " + ", ".join(f"min(round({n}, 6)) AS {n}_lo, max(round({n}, 6)) AS {n}_hi" for n in names) + " FROM c)"


@query(_inside(textchecks.GENRE, 1.0, 1.0))
def genre_band(spark: SparkSession, d: str) -> DataFrame:
    names = textchecks.GENRE
    band = textchecks.bands(rounded(profiles(spark, d, "benchmark", "item_id"), names), names)
    return textchecks.within(rounded(profiles(spark, d), names), band, names).select("id", "n_inside")


@query(_inside(NAMES, 0.75, 1.25))
def corpus_band(spark: SparkSession, d: str) -> DataFrame:
    band = textchecks.bands(rounded(profiles(spark, d, "benchmark", "item_id"), NAMES), NAMES)
    return textchecks.within(rounded(profiles(spark, d), NAMES), band, NAMES, (0.75, 1.25)).select("id", "n_inside")


def _z(source: str) -> str:
    return f"SELECT id, [" + ", ".join(f"coalesce(({n} - {n}_m) / {n}_s, 0)" for n in NAMES) + f"] AS z FROM {source}, st"


def _apart(a: str, b: str) -> str:
    return f"round(sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda q: pow(q[1] - q[2], 2)))), 6)"


_ORIGIN = "[" + ", ".join("0.0::DOUBLE" for _ in NAMES) + "]"


@query(DOCS + ", st AS (SELECT " + ", ".join(f"avg({n}) AS {n}_m, nullif(stddev_pop({n}), 0) AS {n}_s" for n in NAMES) + f""" FROM c), pz AS ({_z('p')}), cz AS ({_z('c')}),
f AS (SELECT pz.id, cz.id AS cid, {_apart('pz.z', 'cz.z')} AS far, {_apart('pz.z', _ORIGIN)} AS central FROM pz, cz),
sp AS (SELECT (SELECT max({_apart('z', _ORIGIN)}) FROM cz) AS widest, (SELECT min({_apart('a.z', 'b.z')}) FROM cz a, cz b WHERE a.id < b.id) AS closest),
n AS (SELECT id, min(far) AS nearest, any_value(central) AS centroid, arg_min(cid, far * 1000000000 + cid) AS nearest_id FROM f GROUP BY 1)
SELECT id, nearest, nearest_id, centroid, centroid <= widest AS inside, nearest >= closest AS no_clone FROM n, sp""")
def style_distance(spark: SparkSession, d: str) -> DataFrame:
    return textchecks.style_distances(profiles(spark, d), profiles(spark, d, "benchmark", "item_id"), NAMES)


@query(DOCS + f""", {SECTIONS}, limits AS (SELECT *, list_transform({_sent(4, 'body')}, lambda x: len({_WORDS.format('x')})::DOUBLE) AS l FROM sections, (SELECT median(median_len) AS c_med FROM c))
SELECT conv_id, n, title, abs(list_median(l) - c_med) <= 8 AS median_ok, list_stddev_pop(l) >= 6 AS sd_ok, list_max(l) <= 55 AS max_ok, {_adverbs('body', config.NO_ADVERBS_OF_SECTIONS)} <= len({_WORDS.format('body')}) / 60::DOUBLE AS adverbs_ok,
{_hits('body', config.PASSIVE)} <= 5 AS passives_ok, NOT regexp_matches({_plain('body')}, '(?i){config.VAGUE}') AS vague_ok FROM limits""")
def section_limits(spark: SparkSession, d: str) -> DataFrame:
    centre = profiles(spark, d, "benchmark", "item_id").agg(F.median("median_len").alias("c_med"))
    return textchecks.section_checks(sections(spark, d), centre)


@query(f"""SELECT doc_id AS id, round({_adverbs('text', config.NO_ADVERBS)} / greatest(len({_WORDS.format('text')}), 1)::DOUBLE * 1000, 6) AS adverbs,
round({_hits('text', config.PASSIVE)} / greatest(len({_sent(3)}), 1)::DOUBLE, 6) AS passives FROM documents""")
def density_rates(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    adverbs = prose.adverbs(text, config.ADVERB, config.NO_ADVERBS) / F.greatest(F.size(prose.words(text)), F.lit(1)) * 1000
    passives = prose.hits(text, config.PASSIVE) / F.greatest(F.size(prose.sentences(text)), F.lit(1))
    return documents(spark, d).select(F.col("doc_id").alias("id"), F.round(adverbs, 6).alias("adverbs"), F.round(passives, 6).alias("passives"))


def _word_count(word: str) -> str:
    if word != config.EXEMPT_WORD:
        return rf"len(regexp_extract_all(t, '(?i)\b{word}\b'))"
    parts = rf"list_transform(string_split_regex(t, '(?i)\b{word}\b'), lambda p: length(p))"
    starts = f"list_transform(range(1, len({parts})), lambda i: (list_sum({parts}[:i]) + (i - 1) * {len(word)})::BIGINT)"
    return f"len(list_filter({starts}, lambda p: NOT regexp_matches(substring(t, greatest(p - {config.EXEMPT_BEFORE}, 0) + 1, least(p, {config.EXEMPT_BEFORE}) + {config.EXEMPT_AFTER}), '(?i){config.EXEMPT_NEAR}')))"


_UNQUOTED = f"regexp_replace({{}}, '{config.QUOTED.replace(chr(39), chr(39) * 2)}', ' ', 'g')"
#: Documents whose beginning stands as a quotation, which isn't counted.
_SAID = "concat('``', replace(substring(text, 1, 80), chr(39), ' '), chr(39), chr(39), ' ', text)"


def _counted(words: list[str], text: str) -> str:
    each = ", ".join("{'word': '" + w + "', 'n': " + _word_count(w) + "}" for w in words)
    return f"SELECT doc_id, u.word AS word, u.n::BIGINT AS n FROM (SELECT doc_id, unnest([{each}]) AS u FROM (SELECT doc_id, {_UNQUOTED.format(_plain(text))} AS t FROM documents))"


@query(_counted(LISTED, "text"))
def banned_vocab(spark: SparkSession, d: str) -> DataFrame:
    return textchecks.word_counts(documents(spark, d), LISTED)


WIDE = ["the", "of", *config.BANNED_WIDE]


@query(_counted(WIDE, _SAID))
def banned_vocab_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wider list, outside of quotations, of which each document gets one."""
    said = F.concat(F.lit("``"), F.replace(F.substring("text", 1, 80), F.lit("'"), F.lit(" ")), F.lit("'' "), "text")
    return textchecks.word_counts(documents(spark, d).withColumn("text", said), WIDE)


_TESTS = ", ".join("regexp_matches(t, '(?is){}') AS {}".format(p.replace("'", "''"), n) for n, p in PATTERNS)
_TESTED = f"SELECT doc_id, {_TESTS} FROM (SELECT doc_id, {_plain('text')} AS t FROM documents)"


@query(_TESTED)
def pattern_battery(spark: SparkSession, d: str) -> DataFrame:
    return textchecks.pattern_hits(documents(spark, d), PATTERNS)


@query(f"SELECT u.name AS check_name, count(*) FILTER (NOT u.hit) AS passed, count(*) AS total FROM (SELECT unnest([{', '.join(chr(123) + repr('name') + ': ' + repr(n) + ', ' + repr('hit') + ': ' + n + chr(125) for n, _ in PATTERNS)}]) AS u FROM ({_TESTED})) GROUP BY 1")
def battery_summary(spark: SparkSession, d: str) -> DataFrame:
    hits = textchecks.pattern_hits(documents(spark, d), PATTERNS)
    long_ = hits.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("hit")) for n, _ in PATTERNS))).alias("u")).select("u.*")
    return long_.groupBy(F.col("name").alias("check_name")).agg(F.count_if(~F.col("hit")).alias("passed"), F.count("*").alias("total"))


#: Results as they would be printed: a count, a share and a mean of each language's documents.
@query("""WITH v AS (SELECT lang, count(*) AS n, count(*) / (SELECT count(*) FROM documents WHERE lang IS NOT NULL)::DOUBLE AS share, avg(n_chars) AS mean FROM documents WHERE lang IS NOT NULL GROUP BY 1),
r AS (SELECT lang || ' n' AS name, n::VARCHAR AS said FROM v UNION ALL SELECT lang || ' share', printf('%.1f', share * 10) FROM v UNION ALL SELECT lang || ' mean', format('{:,}', floor(mean)::BIGINT) FROM v)
SELECT doc_id, name, contains(text, said) AS found FROM documents, r""")
def numeric_provenance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    known = rows.where("lang is not null")
    by = known.groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean")).crossJoin(known.agg(F.count("*").alias("all")))  # one row
    said = {"n": F.col("n").cast("string"), "share": F.format_string("%.1f", F.col("n") / F.col("all") * 10), "mean": F.format_number(F.floor("mean"), 0)}
    results = by.select(F.explode(F.array(*(F.struct(F.concat("lang", F.lit(f" {k}")).alias("name"), v.alias("said")) for k, v in said.items()))).alias("r")).select("r.*")
    return textchecks.provenance(rows.select("doc_id", "text"), results)


@query(f"SELECT doc_id, len(list_filter({_sent(3)}, lambda x: regexp_matches({_plain('x')}, '(?i){config.CAUSAL}') AND NOT regexp_matches({_plain('x')}, '(?i){config.CALM}'))) AS uncalibrated FROM documents")
def claim_calibration(spark: SparkSession, d: str) -> DataFrame:
    bare = F.filter(prose.sentences(F.col("text")), lambda x: prose.has(x, config.CAUSAL) & ~prose.has(x, config.CALM))
    return documents(spark, d).select("doc_id", F.size(bare).cast("long").alias("uncalibrated"))


@query(f"SELECT doc_id, len(list_filter({_sent(3)}, lambda x: {_hits('x', config.HEDGE_STACK)} >= 3)) AS stacked FROM documents")
def hedge_stack(spark: SparkSession, d: str) -> DataFrame:
    stacked = F.filter(prose.sentences(F.col("text")), lambda x: prose.hits(x, config.HEDGE_STACK) >= 3)
    return documents(spark, d).select("doc_id", F.size(stacked).cast("long").alias("stacked"))


@query(DOCS + "SELECT id AS doc_id, len(list_filter(range(1, len(l) - 1), lambda i: l[i] < 8 AND l[i + 1] < 8 AND l[i + 2] < 8)) > 0 AS staccato FROM b")
def staccato_runs(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", textchecks.has_run(prose.lengths(F.col("text")), 8.0).alias("staccato"))


#: Eight dimensions with their scores, caps and weights; the texts' own words stand for the phrases that are looked for.
_FOUND = {"robust": ["the", "of", "and", "with", "for", "que"], "honest": ["les", "der", "und", "not", "no"], "fit": ["la", "en", "die", "to"]}


def _count_sql(words: list[str]) -> str:
    return " + ".join(f"contains(t, ' {w} ')::INT" for w in words)


@query(DOCS + f""", d AS (SELECT id, lower(text) AS t, n_sentences, sd_len, max_len, short_share FROM p JOIN b USING (id))
SELECT id, round(9.0::DOUBLE * 0.1 + (4.0::DOUBLE + CASE WHEN contains(t, ' a ') THEN 0.5 ELSE 0 END) * 0.2 + CASE WHEN coalesce(max_len, 0) - coalesce(sd_len, 0) > 30 THEN 3.5::DOUBLE ELSE 6.0 END * 0.15
+ (4 + {_count_sql(_FOUND['robust'])})::DOUBLE * 0.15 + (CASE WHEN contains(t, ' is ') THEN 7.5::DOUBLE ELSE 6.0 END + CASE WHEN contains(t, ' in ') THEN 0.5 ELSE 0 END) * 0.15
+ least(5 + {_count_sql(_FOUND['honest'])}, 10)::DOUBLE * 0.1 + (10::DOUBLE - CASE WHEN n_sentences < 4 THEN 4 ELSE 0 END - CASE WHEN coalesce(short_share, 0) > 0.5 THEN 1 ELSE 0 END - CASE WHEN contains(t, '{{') THEN 3 ELSE 0 END) * 0.1
+ least(6 + {_count_sql(_FOUND['fit'])}, 10)::DOUBLE * 0.05, 6) AS score FROM d""")
def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("text")

    def found(words: list[str]):
        terms = [F.contains(t, F.lit(f" {w} ")).cast("int") for w in words]
        return sum(terms[1:], terms[0])

    def when(test, yes: float, no: float = 0.0):
        return F.when(test, F.lit(yes)).otherwise(F.lit(no))

    width = F.coalesce("max_len", F.lit(0.0)) - F.coalesce("sd_len", F.lit(0.0))
    craft = F.lit(10.0) - when(F.col("n_sentences") < 4, 4.0) - when(F.coalesce("short_share", F.lit(0.0)) > 0.5, 1.0) - when(F.contains(t, F.lit("{")), 3.0)
    terms = [
        (F.lit(9.0), 10, 0.1),
        (F.lit(4.0) + when(F.contains(t, F.lit(" a ")), 0.5), 10, 0.2),
        (when(width > 30, 3.5, 6.0), 10, 0.15),
        (4 + found(_FOUND["robust"]), 10, 0.15),
        (when(F.contains(t, F.lit(" is ")), 7.5, 6.0) + when(F.contains(t, F.lit(" in ")), 0.5), 10, 0.15),
        (5 + found(_FOUND["honest"]), 10, 0.1),
        (craft, 10, 0.1),
        (6 + found(_FOUND["fit"]), 10, 0.05),
    ]
    rows = textchecks.profile(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return rows.select("id", F.round(textchecks.rubric(terms), 6).alias("score"))


@query("""WITH r AS (SELECT user_id % 5 AS run, list_sort(list_distinct(list(event_type) FILTER (value > 90))) AS failing FROM events GROUP BY 1)
SELECT run, coalesce(array_to_string(list_sort(list_filter(coalesce(failing, []), lambda x: NOT list_contains(coalesce(prior, []), x))), ','), '') AS regressed,
coalesce(array_to_string(list_sort(list_filter(coalesce(prior, []), lambda x: NOT list_contains(coalesce(failing, []), x))), ','), '') AS fixed FROM (SELECT *, lag(failing) OVER (ORDER BY run) AS prior FROM r)""")
def run_regressions(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("run")).agg(F.collect_set(F.when(F.col("value") > 90, F.col("event_type"))).alias("failing"))
    prior = F.coalesce(F.lag("failing").over(Window.orderBy("run")), F.array().cast("array<string>"))  # a row for each run

    def listed(a, b):
        return F.array_join(F.array_sort(F.array_except(a, b)), ",")

    return runs.withColumn("prior", prior).select("run", listed(F.col("failing"), F.col("prior")).alias("regressed"), listed(F.col("prior"), F.col("failing")).alias("fixed"))


@query(f"SELECT 'body' AS kind, doc_id AS id FROM documents WHERE len({_WORDS.format('text')}) > 200 UNION ALL SELECT 'abstract', item_id FROM benchmark")
def corpus_pool(spark: SparkSession, d: str) -> DataFrame:
    bodies = documents(spark, d).where(F.size(prose.words(F.col("text"))) > 200).select(F.lit("body").alias("kind"), F.col("doc_id").alias("id"))
    return bodies.unionByName(table(spark, d, "benchmark").select(F.lit("abstract").alias("kind"), F.col("item_id").alias("id")))
