"""Exports of search results: files of text or JSON, and what is read back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

RECORD = "id string, query string, profile string, createdAt string, summary string"


def file_name(query: Column, created_at: Column, kind: str) -> Column:
    """Time and slug of the query; colons and fractions of seconds do not go into names."""
    stem = X.slug(query)
    when = F.regexp_replace(F.regexp_replace(created_at, ":", "-"), r"\..+", "")
    return F.concat(when, F.lit("-"), F.when(stem == "", "memory-export").otherwise(stem), F.lit(f".{kind}"))


def _iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def build_exports(results: DataFrame, kind: str = "md") -> DataFrame:
    """file, content: one export for each (query, profile, created_at, summary) of results (position, id, scope, score, timestamp_ms, text, metadata, path).

    The results of one search are few (its limit), so each export is one row.
    """
    key = ["query", "profile", "created_at", "summary"]
    file = F.coalesce(X.metadata_field(F.col("metadata"), "file"), X.metadata_field(F.col("metadata"), "heading"), F.lit("-"))
    if kind == "json":
        item = F.struct("id", "scope", "score", F.col("timestamp_ms").alias("timestamp"), "text", "metadata", F.col("path").alias("retrievalPath"))
        items = results.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("position", item.alias("r")))).alias("rows"))
        ident = F.sha2(F.concat_ws("\0", *key), 256).alias("id")
        whole = F.struct(ident, F.lit("memory-export").alias("type"), "query", "profile", F.col("created_at").alias("createdAt"), "summary", F.transform("rows", lambda x: x["r"]).alias("results"))
        return items.select(file_name(F.col("query"), F.col("created_at"), kind).alias("file"), F.concat(F.to_json(whole), F.lit("\n")).alias("content"))
    facts = [("Memory ID", F.col("id").cast("string")), ("Scope", F.col("scope")), ("Score", F.concat(F.round(F.col("score") * 100).cast("int").cast("string"), F.lit("%"))), ("File", file), ("Date", _iso(F.col("timestamp_ms"))), ("Retrieval", F.col("path"))]
    lines = [F.concat(F.lit("### "), F.col("position").cast("string"), F.lit(". "), X.title_of(F.col("text"))), F.lit(""), *(F.concat(F.lit(f"- {name}: "), value) for name, value in facts), F.lit(""), F.col("text"), F.lit("")]
    items = results.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("position", F.concat_ws("\n", *lines).alias("r")))).alias("rows"))
    head = [F.lit("# Memory Export"), F.lit(""), F.concat(F.lit("- Query: "), "query"), F.concat(F.lit("- Profile: "), "profile"), F.concat(F.lit("- Created: "), "created_at"), F.concat(F.lit("- Hits: "), F.size("rows").cast("string")), F.lit(""), F.lit("## Distilled Brief"), F.lit(""), F.col("summary"), F.lit(""), F.lit("## Evidence"), F.lit("")]
    return items.select(file_name(F.col("query"), F.col("created_at"), kind).alias("file"), F.concat_ws("\n", *head, F.array_join(F.transform("rows", lambda x: x["r"]), "\n")).alias("content"))


def parse_exports(files: DataFrame) -> DataFrame:
    """id, query, profile, created_at, format, summary of files (file, content, modified); JSON that is broken is left out."""
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    files = files.withColumn("stem", stem).withColumn("when", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    j = files.where(F.col("file").endswith(".json")).withColumn("j", F.from_json("content", RECORD)).where(F.try_parse_json("content").isNotNull())
    some = lambda c, other: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(other)
    json = j.select(some(F.col("j.id"), F.col("stem")).alias("id"), F.coalesce("j.query", F.lit("")).alias("query"), some(F.col("j.profile"), F.lit("default")).alias("profile"), some(F.col("j.createdAt"), F.col("when")).alias("created_at"), F.lit("json").alias("format"), F.coalesce("j.summary", F.lit("")).alias("summary"), "file")
    m = files.where(F.col("file").endswith(".md"))
    field = lambda name: X.trim(F.regexp_extract("content", rf"(?m)^- {name}: (.*)$", 1))
    lines = F.split("content", "\n")
    at = F.array_position(F.transform(lines, X.trim), "## Distilled Brief").cast("int")
    brief = F.when(at > 0, X.trim(F.array_join(F.slice(lines, at + 2, F.lit(10)), "\n"))).otherwise("")
    md = m.select(F.col("stem").alias("id"), field("Query").alias("query"), some(field("Profile"), F.lit("default")).alias("profile"), some(field("Created"), F.col("when")).alias("created_at"), F.lit("md").alias("format"), brief.alias("summary"), "file")
    return md.unionByName(json)


def write_exports(spark: SparkSession, exports: DataFrame, path: str) -> None:
    """Writes each export as a file under its name; each is the result of one search, so they are few and small."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in exports.toLocalIterator():
        out = fs.create(fs_path(path, row.file), True)
        out.write(bytearray(row.content.encode()))
        out.close()


def read_exports(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The newest exports under path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{md,json}").load(path)
    newest = found.orderBy(F.desc("modificationTime"), "path").limit(limit).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))
    return parse_exports(newest)


def filter_exports(exports: DataFrame, needle: str) -> DataFrame:
    low = F.lower(F.concat_ws(" ", "query", "profile", "format", "summary"))
    return exports.where(F.contains(low, F.lit(needle.lower()))) if needle else exports
