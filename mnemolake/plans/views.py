"""What people and programs see of search results: rows, lines and JSON. Results are one search's, 20 at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import summary


def percent(score: Column) -> Column:
    return F.concat(F.round(score * 100).cast("int").cast("string"), F.lit("%"))


def session_label(metadata: Column, scope: Column) -> Column:
    """The first eight characters of the session, or the scope."""
    session = X.metadata_field(metadata, "session")
    return F.when(session.isNotNull(), F.substring(session, 1, 8)).otherwise(F.coalesce(scope, F.lit("-")))


def search_rows(labelled: DataFrame, path: Column) -> DataFrame:
    """position and line of each labelled result: place, id, score, source, date, how it was found, file and snippet."""
    cell = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)
    parts = [cell(F.col("position").cast("string"), 2), cell(F.substring(F.col("id").cast("string"), 1, 8), 8), cell(percent(F.col("score")), 5), cell(F.col("source"), 7), F.col("date"), cell(path, 20), F.col("file"), F.lit("|"), X.clean_snippet(F.col("snippet"), 120)]
    return labelled.select("position", F.concat_ws(" ", *parts).alias("line"))


def explain_rows(labelled: DataFrame, path: Column, why: Column) -> DataFrame:
    """position and text of each result with the reasons it was found for."""
    head = F.concat(F.col("position").cast("string"), F.lit(". "), F.concat_ws(" | ", F.substring(F.col("id").cast("string"), 1, 8), percent(F.col("score")), "source", "date"))
    named = [("path", path), ("session", session_label(F.col("metadata"), F.col("scope"))), ("file", F.col("file")), ("why", why), ("snippet", F.col("snippet"))]
    return labelled.select("position", F.concat_ws("\n", head, *(F.concat(F.lit(f"   {n:<8}: "), c) for n, c in named)).alias("text"))


def projected(labelled: DataFrame, path: Column) -> DataFrame:
    """The rows that programs get."""
    return labelled.select("position", F.col("id").cast("string").alias("id"), "scope", "source", "date", "file", F.round("score", 6).alias("score"), path.alias("retrieval_path"), "snippet")


def distilled(labelled: DataFrame, query: str, profile: str, path: Column) -> DataFrame:
    """One row: query, profile, hits, sources, takeaways, evidence and reusable texts of one search."""
    rows = lambda df, order, item: df.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), item.alias("_x")))), lambda s: s["_x"]).alias("x"))
    sources = rows(summary.source_map(labelled), "place", F.struct("source", F.col("hits").cast("int").alias("hits"))).withColumnRenamed("x", "sources")
    taken = rows(summary.takeaways(labelled), "position", F.col("takeaway")).withColumnRenamed("x", "takeaways")
    shown = rows(summary.evidence(labelled, path), "position", F.struct(F.col("memory_id").cast("string").alias("memory_id"), "source")).withColumnRenamed("x", "evidence")
    again = rows(summary.reusable(labelled), "position", F.col("candidate")).withColumnRenamed("x", "reusable")
    hits = labelled.agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(sources).join(taken).join(shown).join(again).select(F.lit(query).alias("query"), F.lit(profile).alias("profile"), "hits", "sources", "takeaways", "evidence", "reusable")


def collapsed(text: Column, most: int) -> Column:
    """The first lines of a text and how many more there are; shorter texts as they are."""
    lines = F.split(text, "\n", -1)
    more = (F.size(lines) - most).cast("string")
    return F.when(F.size(lines) <= most, text).otherwise(F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit("\n\n... ("), more, F.lit(" more lines)")))


def card_text(source: Column, metadata: Column, text: Column) -> Column:
    """What a card shows: an asset's title, or its text without labels, or the text in one line; - where there is none."""
    plain = X.collapse(F.coalesce(text, F.lit("")))
    own = X.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"(?i)^\[Pinned Asset\]\s*", ""), "(?i)Original Scope:.*$", ""), "(?i)Snippet:.*$", ""))
    asset = source == "asset"
    return F.when(asset & X.metadata_field(metadata, "title").isNotNull(), X.metadata_field(metadata, "title")).when(plain == "", "-").when(asset & (own != ""), own).otherwise(plain)


def by_source(labelled: DataFrame) -> DataFrame:
    """place, source, hits and ids of each source of a search's results, in the order in which sources first come."""
    source = F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit("unknown"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("id").cast("string").alias("id")))), lambda x: x["id"])
    found = labelled.groupBy(source.alias("source")).agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("hits"), ids.alias("ids"))
    return found.select(F.row_number().over(W.orderBy("first")).cast("long").alias("place"), "source", "hits", "ids")


def as_results(entries: DataFrame) -> DataFrame:
    """Stored entries in the form of results that were not searched for: their importance is their score."""
    weight = F.col("importance")
    return entries.withColumn("score", F.when(weight.isNull() | F.isnan(weight) | (weight == 0), 0.7).otherwise(weight)).withColumn("fused", F.col("score"))


def distill_lines(row) -> list[str]:
    """A distilled() row as text."""
    if not row.hits:
        return ["No results found."]
    number = lambda items: [f"{i}. {x}" for i, x in enumerate(items, 1)]
    return [f"Query   : {row.query}", f"Profile : {row.profile}", f"Hits    : {row.hits}", "", "Source Map", *(f"{s.source:<10} {s.hits}" for s in row.sources), "", "Core Takeaways", *number(row.takeaways), "", "Evidence", *number(f"{e.memory_id} | {e.source}" for e in row.evidence), "", "Reusable Memory Candidates", *number(row.reusable or ["No strong candidate yet; widen the query or the profile."])]
