"""Files as sources and sinks: CSV, JSON documents, JSON lines, listings, manifests and reports.

All readers take paths of any file system that Spark reads. Columns of text stay text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import sampling

_QUOTED = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
MISSING = "[NOT YET COMPUTED]"


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of CSV files with headers, all columns text; quoted fields may hold line ends, bytes that aren't UTF-8 become U+FFFD.

    Several files are one table; they must have the same header. Empty fields are null. A file with quoted line
    ends is read by one task.
    """
    return spark.read.options(**_QUOTED, multiLine="true", enforceSchema="false").csv(paths)


def write_csv(rows: DataFrame, path: str) -> None:
    """Overwrites a folder of CSV files with headers; nulls are empty fields."""
    rows.write.mode("overwrite").options(**_QUOTED).csv(path)


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, file and bytes of the folder's files, at any depth; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.regexp_extract("path", r"[^/]*$", 0).alias("file"), F.col("length").alias("bytes"))


def read_shards(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """The rows of the most complete set of shards ``<prefix>..._<k>of<n>.csv`` in a folder; each shard is a file or a folder of files."""
    names = listing(spark, folder, "*.csv").select("path", F.explode(F.split("path", "/")).alias("file"))
    named = names.where(F.startswith("file", F.lit(prefix)) & F.rlike("file", F.lit(r"_\d+of\d+\.csv$")))
    kept = sampling.complete_set(named.select("file").distinct()).select("file")
    paths = named.join(kept, "file", "left_semi").select("path").distinct().collect()  # a name for each file of a set of shards
    return read_csv(spark, sorted(r["path"] for r in paths))


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One row: the JSON document of a file; no row where the file is missing."""
    return _existing(spark, path, schema, {"multiLine": "true"})


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A row for each line that isn't blank; lines that don't parse are null in all columns. No row where the file is missing."""
    return _existing(spark, path, schema, {})


def _existing(spark: SparkSession, path: str, schema: StructType | str, options: dict[str, str]) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(**options).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Overwrites a folder of JSON lines; null fields are written too."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json(document: DataFrame, path: str) -> None:
    """Overwrites a folder with one file that holds the one row of ``document``; more rows are an error."""
    if document.limit(2).count() != 1:
        raise ValueError("a document is one row")
    document.select(F.to_json(F.struct(*document.columns), {"ignoreNullFields": "false", "pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


MANIFEST = "date string, record_count long, files array<struct<url:string, record_count:long>>"


def manifest_files(manifest: DataFrame) -> DataFrame:
    """path (without scheme), key, place in the order of paths, and the manifest's date, which pins the version, of each file."""
    each = manifest.select("date", F.explode("files").alias("f")).select("date", F.regexp_replace("f.url", "^s3://", "").alias("path"), F.col("f.record_count").alias("record_count"))
    place = F.row_number().over(sampling.Window.orderBy("path")) - 1  # a row for each file
    return each.select("date", "path", file_key(F.col("path")).alias("key"), place.cast("long").alias("place"), "record_count")


def file_key(path: Column) -> Column:
    """The file's name, "@" and the ten characters that name its partition's date: what a resumed scan remembers."""
    return F.concat(F.regexp_extract(path, r"[^/]*$", 0), F.lit("@"), F.substring(F.regexp_extract(path, r"(?:.*updated_date=)?(.*)$", 1), 1, 10))


def anonymous(spark: SparkSession) -> None:
    """From now on s3a:// paths are read without credentials."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.s3a.aws.credentials.provider", "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider")


def report(values: DataFrame, title: str) -> DataFrame:
    """n and line of a Markdown report of (name, value): each value, at most 300 characters of it, then the names that have none."""
    said = F.coalesce("value", F.lit(MISSING))
    lines = values.select(F.lit(1).alias("part"), "name", F.concat(F.lit("- `"), F.col("name"), F.lit("`: "), F.substring(said, 1, 300)).alias("line"))
    absent = values.where((said == MISSING) | F.contains(said, F.lit(MISSING)))
    lines = lines.unionByName(absent.select(F.lit(4).alias("part"), "name", F.concat(F.lit("- "), F.col("name")).alias("line")))
    count = absent.agg(F.count("*").alias("k")).select(F.lit(3).alias("part"), F.lit("").alias("name"), F.concat(F.lit("## Still missing: "), F.col("k").cast("string")).alias("line"))
    head = values.sparkSession.createDataFrame([(0, "", f"# {title}"), (0, "~", ""), (2, "", "")], "part int, name string, line string")
    whole = lines.unionByName(count).unionByName(head)
    place = F.row_number().over(sampling.Window.orderBy("part", "name")) - 1  # a report's lines
    return whole.select(place.cast("long").alias("n"), "line")
