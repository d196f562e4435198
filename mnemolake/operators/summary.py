"""What a set of results says: sources, takeaways, evidence, reusable texts, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import DAY_MS, NOW_MS


def labelled(results: DataFrame, query_terms: list[str]) -> DataFrame:
    """results (with position) plus source, file, date and snippet."""
    source = X.source_label(F.col("metadata"), F.col("scope"))
    return results.withColumn("source", source).withColumn("file", X.file_label(F.col("metadata"))).withColumn("date", X.date_label(F.col("timestamp_ms"))).withColumn("snippet", X.best_snippet(X.recall_text(F.col("text"), source), query_terms))


def seeds(results: DataFrame) -> DataFrame:
    """Results that are no assets, or all if all are."""
    own = results.withColumn("_s", X.source_label(F.col("metadata"), F.col("scope")))
    return own.withColumn("_n", F.count_if(F.col("_s") != "asset").over(W.partitionBy())).where((F.col("_s") != "asset") | (F.col("_n") == 0)).drop("_s", "_n")


def source_map(rows: DataFrame) -> DataFrame:
    """source, hits, newest, files (the first three), in order of hits and first place."""
    first = rows.where(F.col("file") != "-").groupBy("source", "file").agg(F.min("position").alias("p"))
    files = first.groupBy("source").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("p", "file"))), 1, 3), lambda s: s["file"]), ",").alias("files"))
    main = rows.groupBy("source").agg(F.count(F.lit(1)).alias("hits"), F.max("timestamp_ms").alias("ts"), F.min("position").alias("p"))
    return main.join(files, "source", "left").select("source", "hits", X.date_label(F.col("ts")).alias("newest"), F.coalesce("files", F.lit("")).alias("files"), F.row_number().over(W.orderBy(F.desc("hits"), "p")).cast("long").alias("place"))


def first_distinct(rows: DataFrame, value: Column, name: str, most: int) -> DataFrame:
    d = rows.select(value.alias(name), "position").groupBy(name).agg(F.min("position").alias("position"))
    return d.orderBy("position").limit(most)


def takeaways(rows: DataFrame) -> DataFrame:
    return first_distinct(rows, F.concat("source", F.lit(": "), "snippet"), "takeaway", 4)


def reusable(rows: DataFrame) -> DataFrame:
    return first_distinct(rows.where(F.length("snippet") >= 20), F.col("snippet"), "candidate", 3)


def evidence(rows: DataFrame, path: Column) -> DataFrame:
    return rows.orderBy("position").limit(5).select(F.col("id").alias("memory_id"), "source", "scope", "date", path.alias("retrieval_path"), "snippet", "position")


def why_matched(query_terms: list[str], vec: Column, bm25: Column, reranked: Column | None = None, now_ms: int = NOW_MS) -> Column:
    terms = X.matched_terms(F.array(*map(F.lit, query_terms)) if query_terms else F.array().cast("array<string>"), F.col("text"))
    days = F.greatest(F.lit(0.0), (F.lit(now_ms) - F.col("timestamp_ms")) / float(DAY_MS))
    heading = X.metadata_field(F.col("metadata"), "heading")
    parts = [
        F.when(vec & bm25, "semantic+keyword").when(vec, "semantic").when(bm25, "keyword"),
        *([F.when(reranked, "reranked")] if reranked is not None else []),
        F.when(F.size(terms) > 0, F.concat(F.lit("terms:"), F.array_join(F.slice(terms, 1, 3), ","))),
        F.when((F.col("timestamp_ms") > 0) & (days <= 14), F.concat(F.lit("fresh:"), F.round(days).cast("int").cast("string"), F.lit("d"))),
        F.when(F.col("weight") >= 0.7, "important"),
        F.when(heading.isNotNull(), F.concat(F.lit("heading:"), F.substring(heading, 1, 24))),
    ]
    joined = F.concat_ws(" | ", *parts)
    return F.when(joined != "", joined).otherwise("retrieved")
