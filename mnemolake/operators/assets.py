"""Pins, briefs and exports: building, indexing, listing and their upkeep."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

BRIEF = "id string, title string, summary string, query string, profile string, created_at string, hits int, sources array<struct<source:string,hits:int>>, takeaways array<string>, evidence array<struct<memory_id:string,source:string>>, reusable array<string>, tags array<string>"
PIN = "id string, type string, created_at string, title string, summary string, snippet string, tags array<string>, memory_id string, original_scope string, promoted double"
IMPORTANCE = {"memory-brief": 0.72, "pinned-memory": 0.96}


def _line(label: str, c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))


def pin_text(title: Column, summary: Column, snippet: Column, scope: Column, tags: Column) -> Column:
    return F.concat_ws("\n", _line("[Pinned Asset] ", title), _line("Summary: ", summary), _line("Snippet: ", snippet), _line("Original Scope: ", scope), _line("Tags: ", F.array_join(tags, ", ")))


def brief_text(b: DataFrame) -> DataFrame:
    sources = F.array_join(F.transform("sources", lambda s: F.concat(s["source"], F.lit("("), s["hits"].cast("string"), F.lit(")"))), ", ")
    parts = [("[Memory Brief] ", F.col("title")), ("Query: ", F.col("query")), ("Profile: ", F.col("profile")), ("Summary: ", F.col("summary")), ("Takeaways: ", F.array_join("takeaways", " | ")), ("Reusable: ", F.array_join("reusable", " | ")), ("Sources: ", sources), ("Tags: ", F.array_join("tags", ", "))]
    return b.withColumn("text", F.concat_ws("\n", *(_line(a, c) for a, c in parts)))


def build_pins(memories: DataFrame, created_at: str) -> DataFrame:
    """A pin for each memory: title, summary, snippet and tags from its text; the memory's importance rises to 0.95."""
    t = F.col("text")
    return memories.select(
        F.sha2(F.concat_ws(":", F.lit("pin"), "id"), 256).alias("id"), F.lit("pinned-memory").alias("type"), F.lit(created_at).alias("created_at"),
        X.title_of(t).alias("title"), X.clean_snippet(t, 240).alias("summary"), X.clean_snippet(t, 320).alias("snippet"), X.tags(t).alias("tags"),
        F.col("id").cast("string").alias("memory_id"), F.col("scope").alias("original_scope"), F.greatest(F.coalesce("importance", F.lit(0.7)), F.lit(0.95)).alias("promoted"),
    )


def dirty_reasons() -> Column:
    has = lambda c: F.exists(c, lambda x: x["source"] == "asset")
    return F.array_compact(
        F.array(
            F.when(has("sources"), "source includes asset"),
            F.when(F.exists("takeaways", lambda t: t.startswith("asset:")), "takeaways include asset"),
            F.when(has("evidence"), "evidence includes asset"),
            F.when(F.col("summary").rlike(X.ASSET_MARK), "summary contains asset marker"),
            F.when(F.exists("reusable", lambda t: t.rlike(X.ASSET_MARK)), "reusable candidate contains asset marker"),
        )
    )


def dirty_briefs(briefs: DataFrame, limit: int = 200) -> DataFrame:
    newest = briefs.orderBy(F.desc("created_at"), "id").limit(limit)
    return newest.withColumn("reasons", dirty_reasons()).where(F.size("reasons") > 0).withColumn("scope", F.concat(F.lit("asset:brief:"), F.substring("id", 1, 8)))


def union_recent(pins: DataFrame, briefs: DataFrame, limit: int = 12) -> DataFrame:
    own = ["id", "type", "title", "created_at", "tags", *(["scope"] if "scope" in pins.columns and "scope" in briefs.columns else [])]
    return pins.select(*own).unionByName(briefs.withColumn("type", F.lit("memory-brief")).select(*own)).orderBy(F.desc("created_at"), "id").limit(limit)


def top_tags(df: DataFrame, limit: int = 8) -> DataFrame:
    return df.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def filter_assets(df: DataFrame, needle: str = "", tag: str | None = None) -> DataFrame:
    low = F.lower(F.concat_ws(" ", "title", "type", F.array_join("tags", " ")))
    out = df.where(F.contains(low, F.lit(needle.lower()))) if needle else df
    return out.where(F.array_contains("tags", tag)) if tag else out


def build_briefs(facts: DataFrame, created_at: str) -> DataFrame:
    """BRIEF rows of summaries (query, profile, hits, sources, takeaways, evidence, reusable), one of each search.

    The summary is made of the takeaways without their sources, or names the query where there are none.
    """
    takeaways = F.slice("takeaways", 1, 4)
    plain = X.trim(F.array_join(F.transform(takeaways, lambda t: F.regexp_replace(t, r"^[^:]+:\s*", "")), " "))
    told = F.when(plain != "", plain).otherwise(F.concat(F.lit("Brief for "), "query"))
    tags = X.tags(F.concat_ws(" ", "query", F.array_join(takeaways, " "), F.array_join(F.transform("sources", lambda s: s["source"]), " ")))
    return facts.select(
        F.sha2(F.concat_ws(":", F.lit("brief"), "query", "profile", F.lit(created_at)), 256).alias("id"), F.concat("query", F.lit(" brief")).alias("title"), X.clean_snippet(told, 260).alias("summary"), "query", "profile",
        F.lit(created_at).alias("created_at"), F.col("hits").cast("int").alias("hits"), "sources", takeaways.alias("takeaways"), F.slice("evidence", 1, 6).alias("evidence"), F.slice("reusable", 1, 4).alias("reusable"), tags.alias("tags"),
    )


def memory_rows(assets: DataFrame, kind: str) -> DataFrame:
    """Assets (id, title, text, tags; memory_id and original_scope of pins, query and profile of briefs) as rows to be stored."""
    short = F.substring("id", 1, 8)
    own = [F.lit("asset").alias("source"), F.col("id").alias("assetId"), F.lit(kind).alias("assetType"), "title"]
    more = ["query", "profile", "tags"] if kind == "memory-brief" else [F.col("memory_id").alias("originalMemoryId"), F.col("original_scope").alias("originalScope"), "tags"]
    prefix = "asset:brief:" if kind == "memory-brief" else "asset:"
    return assets.select("text", F.lit("decision").alias("category"), F.concat(F.lit(prefix), short).alias("scope"), F.lit(IMPORTANCE[kind]).alias("importance"), F.to_json(F.struct(*own, *more)).alias("metadata"))


def summary_line(kind: str, scope: Column) -> Column:
    """One line on an asset: id, kind, title, scope and day."""
    place = F.when(F.coalesce(scope, F.lit("")) != "", F.substring(scope, 1, 24)).otherwise("brief") if kind == "brief" else scope
    return F.concat(F.substring("id", 1, 8), F.lit(f"  {kind:<5}  "), "title", F.lit("  ["), place, F.lit("]  "), F.substring("created_at", 1, 10))


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def save(assets: DataFrame, path: str) -> None:
    """Writes each asset (id, created_at, ...) as a JSON file of its own, named by time and id; what is saved at once comes from a few searches."""
    fs, where = _files(assets.sparkSession, path)
    names = F.concat(F.regexp_replace("created_at", "[^0-9A-Za-z]", ""), F.lit("-"), F.col("id"), F.lit(".json"))
    for row in assets.select(names.alias("name"), F.to_json(F.struct(*assets.columns)).alias("content")).toLocalIterator():
        out = fs.create(assets.sparkSession._jvm.org.apache.hadoop.fs.Path(where, row.name), True)
        out.write(bytearray(row.content.encode()))
        out.close()


def newest_files(spark: SparkSession, path: str, limit: int) -> list[str]:
    """The paths of the last files by name, which begins with the time, from a listing alone; limit at most."""
    fs, where = _files(spark, path)
    if not fs.exists(where):
        return []
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path")  # no content is read
    return [r.path for r in listed.orderBy(F.desc(F.element_at(F.split("path", "/"), -1))).limit(limit).collect()]


def read(spark: SparkSession, path: str, schema: str, limit: int = 20) -> DataFrame:
    """The newest assets of a folder: only `limit` files are opened, and those that are no JSON are left out. A folder that is not there is empty."""
    paths = newest_files(spark, path, limit)
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(paths)
    return rows.where("id is not null").orderBy(F.desc("created_at"), "id")


def _matching(spark: SparkSession, path: str, beginning: str) -> list:
    if not re.fullmatch(r"[0-9A-Za-z_.]+", beginning):
        raise ValueError(f"not an id: {beginning}")
    fs, where = _files(spark, path)
    return list(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(where, f"*-{beginning}*.json")) or []) if fs.exists(where) else []


def find_pin(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """The pin whose id is `wanted` or begins with it, by the names of files; no row if there is none, an error if there are several."""
    found = [f.getPath().toString() for f in _matching(spark, path, wanted)]
    exact = [f for f in found if f.endswith(f"-{wanted}.json")]
    if len({f.rsplit("-", 1)[1] for f in exact or found}) > 1:
        raise ValueError(f"ambiguous pin id prefix: {wanted}")
    return spark.read.schema(PIN).option("multiLine", True).json(exact or found).limit(1) if found else spark.createDataFrame([], PIN)


def archive(spark: SparkSession, path: str, to: str, ids: list[str]) -> None:
    """Moves the files of assets to another folder; others are not touched."""
    fs, target = _files(spark, to)
    fs.mkdirs(target)
    for i in ids:
        for f in _matching(spark, path, i):
            if f.getPath().getName().endswith(f"-{i}.json"):
                fs.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(target, f.getPath().getName()))
