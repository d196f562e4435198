"""The ledger of ingested files: what was taken in, how large it was and how many chunks it gave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mark(ledger: DataFrame, files: DataFrame, now: str) -> DataFrame:
    """ledger with files (path, size, mtime_ms, chunks) marked: of each path the last mark stays."""
    both = ledger.withColumn("_n", F.lit(0)).unionByName(files.withColumn("ingested_at", F.lit(now)).withColumn("_n", F.lit(1)), allowMissingColumns=True)
    last = both.withColumn("_r", F.row_number().over(W.partitionBy("path").orderBy(F.desc("_n"), F.desc("ingested_at"))))
    return last.where("_r = 1").drop("_n", "_r")


def stats(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("chunks"))
