"""Secret scans with corpus-wide ownership frequency.

Every text is searched for candidate credentials. The hash of each candidate's value is
counted over the whole corpus by distinct repositories and owners: a value that many
owners have is a widely copied example, one that a single owner has and that looks random
is live. Base kinds are always reported. Added kinds are provider tokens and private key
headers, always, and random-looking strings without a telling name where ownership says
that they aren't widely copied.

Nulls count as empty: no findings. A null repository counts as a repository of its own,
named by the empty string. Values themselves never leave the scanning task, only hashes. Repeated
rows give a row each.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialize

#: The base kinds' patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # of a run of such characters, the part from its first AKIA on
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
#: Added kinds: formats that name their provider, key headers, and long runs of key characters.
PROVIDER = re.compile(r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})")
KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "provider", "key", "random")
BASE_KINDS = KINDS[:3]

#: A value of this many owners is a copied example; bits a character that a random-looking value has.
EXAMPLE_OWNERS, LEAST_BITS = 5, 3.0
MASK = "[SECRET]"

FOUND = "array<struct<start:long, rank:int, end:long, value_start:long, value_end:long, hash:string, bits:double>>"


def bits(value: str) -> float:
    """Shannon entropy of a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def candidates(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind's rank, end, value's start, value's end), sorted."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text)]
    found += [(m.start(), 3, m.end(), *m.span()) for m in PROVIDER.finditer(text)]
    if "-----BEGIN " in text:
        found += [(m.start(), 4, m.end(), *m.span()) for m in KEY.finditer(text)]
    taken = sorted((a, b) for a, _, b, _, _ in found)
    at = 0
    for m in RANDOM.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        apart = at == len(taken) or taken[at][0] >= m.end()
        if apart and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and bits(m[0]) >= LEAST_BITS:
            found.append((m.start(), 5, m.end(), *m.span()))
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[rank]}:{start}:{end}" for start, rank, end in spans)


def scanned(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """A narrow row for each document: counts and digest of the base spans, and all candidates."""
    schema = "doc_id long, key long, repository string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found " + FOUND
    made = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("value_start", pa.int64()), ("value_end", pa.int64()), ("hash", pa.string()), ("bits", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, lists = ([], [], []), [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                found = candidates(text)
                for rank, column in enumerate(counts):
                    column.append(sum(f[1] == rank for f in found))
                digests.append(hashlib.sha256(joined([f[:3] for f in found if f[1] < len(BASE_KINDS)]).encode()).hexdigest())
                lists.append([{"start": a, "rank": r, "end": b, "value_start": x, "value_end": y, "hash": hashlib.sha256(text[x:y].encode()).hexdigest()[:32], "bits": bits(text[x:y])} for a, r, b, x, y in found])
            kept = ["doc_id", "key", "repository", "owner"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(lists, made)], names=[*kept, "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"), F.coalesce(repository, F.lit("")).alias("repository"), F.coalesce(owner, F.lit("")).alias("owner"), text.alias("text"))
    return rows.mapInArrow(run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners, n_places and status of each value; pairs of a value and its owner are aggregated before they meet."""
    pairs = found.groupBy("hash", "repository", "owner").agg(F.count("*").alias("places"), F.max("bits").alias("bits"))
    counts = pairs.groupBy("hash").agg(F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"), F.sum("places").alias("n_places"), F.max("bits").alias("bits"))
    status = F.when(F.col("n_owners") >= EXAMPLE_OWNERS, "example").when((F.col("n_owners") == 1) & (F.col("bits") >= LEAST_BITS), "live").otherwise("shared")
    return counts.withColumn("status", status).drop("bits")


def findings(docs: DataFrame, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """A row for each row of docs with its findings: kind, start, end, value's start and end, status.

    ``repository`` is by default the column source and ``owner`` what stands before its
    first slash. The scan's narrow result is written once, counted by value, and joined
    back to the documents; the texts are read once.
    """
    bounded_batches(docs.sparkSession)
    repository = F.col("source").cast("string") if repository is None else repository
    owner = F.substring_index(repository, "/", 1) if owner is None else owner
    rows = materialize(scanned(docs, repository, owner).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = rows.where(F.size("found") > 0).select("row", "repository", "owner", F.explode("found").alias("f")).select("row", "repository", "owner", "f.*")
    status = each.join(ownership(each), "hash", "left")
    kept = status.where((F.col("rank") < KINDS.index("random")) | (F.col("status") != "example"))
    kinds = F.array(*map(F.lit, KINDS))
    span = F.struct("start", "rank", "end", F.element_at(kinds, F.col("rank") + 1).alias("kind"), "value_start", "value_end", "status")
    lists = kept.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("findings"))
    return rows.drop("found").join(lists, "row", "left").withColumn("findings", F.coalesce("findings", F.array().cast(T.ArrayType(lists.schema["findings"].dataType.elementType)))).drop("row")


def scan(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, all spans, and how many of them are live or examples."""
    text = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    def count(status: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["status"] == status)).cast("long")

    return findings(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), count("live").alias("n_live"), count("example").alias("n_example"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every finding's value replaced by MASK, copied examples excepted; n_chars, if there, follows.

    Findings meet their rows by doc_id and the text's hash, so repeated rows are masked alike; the row's own columns
    are kept aside, whatever they are called. Null and empty texts stay.
    """
    marked = findings(docs).select("doc_id", "key", F.filter("findings", lambda f: f["status"] != "example").alias("_findings")).where(F.size("_findings") > 0)
    marked = marked.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.first("_findings").alias("_findings"))

    @F.pandas_udf(T.StringType())
    def masked(texts, lists):
        out = []
        for text, found in zip(texts, lists, strict=True):
            if found is not None:
                parts, at = [], 0
                for start, end in sorted((f["value_start"], f["value_end"]) for f in found):
                    if start >= at:
                        parts += [text[at:start], MASK]
                    at = max(at, end)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return texts.__class__(out, dtype=object)

    text = F.col("text").cast("string")
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").cast("long").alias("_of"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_key_of"))
    both = packed.join(marked, F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_key_of") == F.col("_key")), "left")
    found = F.col("_findings").isNotNull()
    both = both.withColumn("_text", F.when(found, masked(F.col("_doc.text").cast("string"), F.col("_findings"))).otherwise(F.col("_doc.text")))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(found, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars"))
    return both.select(*(changed.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns))
