"""The memory table: its schema, and a view of the fixture tables in that shape."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOW_MS = 1706745600000
DAY_MS = 86_400_000
MEMORY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("category", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("importance", T.DoubleType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("metadata", T.StringType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a local one only for a local master that names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and (not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(shared or os.path.join(tempfile.gettempdir(), 'mnemolake-shared')).rstrip('/')}/mnemolake/{name}-{uuid.uuid4().hex}"


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined with embeddings and labels as memory rows; id is the doc_id."""
    d, e, l = (table(spark, sf_dir, t) for t in ("documents", "embeddings", "labels"))
    joined = d.join(e.withColumnRenamed("vec_id", "doc_id").select("doc_id", "embedding"), "doc_id").join(l.select("doc_id", "quality"), "doc_id", "left")
    n = (F.col("doc_id") % 7).cast("string")
    kind = F.col("doc_id") % 5
    scope = F.when(kind == 0, F.concat(F.lit("cc:"), n)).when(kind == 1, F.concat(F.lit("codex:"), n)).when(kind == 2, F.concat(F.lit("gemini:"), n)).when(kind == 3, F.lit("memory"))
    scope = scope.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("asset:brief:"), n)).otherwise(F.concat(F.lit("asset:"), n))
    asset = F.when(F.col("doc_id") % 2 == 0, F.lit('{"source":"asset","assetType":"memory-brief"}')).otherwise(F.lit('{"source":"asset","assetType":"pinned-memory"}'))
    plain = F.concat(F.lit('{"source":"'), F.element_at(F.split(scope, ":"), 1), F.lit('","file":"f'), (F.col("doc_id") % 9).cast("string"), F.lit('.md","heading":"h'), (F.col("doc_id") % 11).cast("string"), F.lit('"}'))
    return joined.select(
        F.col("doc_id").alias("id"),
        "text",
        F.col("embedding").alias("vector"),
        F.when(kind == 4, "decision").otherwise("fact").alias("category"),
        scope.alias("scope"),
        F.when(F.col("quality") == 1, 0.95).when(F.col("quality") == 0, 0.6).otherwise(0.7).alias("importance"),
        (F.lit(NOW_MS) - F.pmod(F.col("doc_id") * 7919, F.lit(180)) * DAY_MS).alias("timestamp_ms"),
        F.when(kind == 4, asset).otherwise(plain).alias("metadata"),
    )


MEMORIES_SQL = f"""mem AS (SELECT d.doc_id AS id, d.text, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS v,
 CASE WHEN d.doc_id % 5 = 4 THEN 'decision' ELSE 'fact' END AS category,
 CASE d.doc_id % 5 WHEN 0 THEN 'cc:' || (d.doc_id % 7) WHEN 1 THEN 'codex:' || (d.doc_id % 7) WHEN 2 THEN 'gemini:' || (d.doc_id % 7) WHEN 3 THEN 'memory'
  ELSE CASE WHEN d.doc_id % 2 = 0 THEN 'asset:brief:' || (d.doc_id % 7) ELSE 'asset:' || (d.doc_id % 7) END END AS scope,
 CASE l.quality WHEN 1 THEN 0.95::DOUBLE WHEN 0 THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END AS importance,
 {NOW_MS} - ((d.doc_id * 7919) % 180) * {DAY_MS} AS timestamp_ms,
 CASE WHEN d.doc_id % 5 = 4 THEN 'asset' ELSE CASE d.doc_id % 5 WHEN 0 THEN 'cc' WHEN 1 THEN 'codex' WHEN 2 THEN 'gemini' ELSE 'memory' END END AS source,
 CASE WHEN d.doc_id % 5 = 4 THEN '-' ELSE 'f' || (d.doc_id % 9) || '.md' END AS file,
 CASE WHEN d.doc_id % 5 <> 4 THEN 'h' || (d.doc_id % 11) END AS heading
 FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
