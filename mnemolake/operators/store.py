"""The memory table: rows that are only ever added, joined on reading to those that replace or remove them."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import MEMORY
from .search import scope_predicate

#: row names one version of an entry, replaces the version that this row takes the place of, file and taken what it was read from and when.
STORED = T.StructType([*MEMORY.fields, *(T.StructField(c, T.StringType()) for c in ("row", "replaces", "file", "taken"))])
LEDGER = "path string, size long, mtime_ms double, chunks long, ingested_at string"


class Store:
    """Entries under path/rows and the ledger of files under path/ledger, both plain Parquet that Spark appends to.

    Every change is one append: of new entries, of an entry's next version, which names the one before in `replaces`, or of
    a row without id that only names what it removes. So a change writes its own rows only, is whole or absent, and
    appends of several writers do not meet. Two writers that change one entry at once leave both versions.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int | None = None):
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._fs_path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, name: str, schema) -> DataFrame:
        there = self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"))
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def live(self) -> DataFrame:
        """The last version of every entry, with row, file and taken."""
        rows = self._folder("rows", STORED)
        gone = rows.where("replaces is not null").select(F.col("replaces").alias("row"))
        return rows.where("id is not null").join(gone, "row", "left_anti").drop("replaces")

    def versions(self) -> DataFrame:
        """Every version that was ever stored."""
        return self._folder("rows", STORED).where("id is not null")

    def read(self) -> DataFrame:
        return self.live().select(*MEMORY.fieldNames())

    def _add(self, rows: DataFrame) -> None:
        have = set(rows.columns)
        rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in STORED.fields)).write.mode("append").parquet(f"{self.path}/rows")

    def completed(self, rows: DataFrame, now_ms: int) -> DataFrame:
        """rows as they are stored: each gets an id of its own where it has none, and the usual category, scope, importance, time and metadata."""
        have = set(rows.columns)
        col = lambda name, other: F.coalesce(F.col(name), other) if name in have else other
        weight = col("importance", F.lit(0.7)).cast("double")
        full = rows.select(
            col("id", F.expr("uuid()")).cast("string").alias("id"), "text", "vector",
            col("category", F.lit("fact")).alias("category"), col("scope", F.lit("global")).alias("scope"),
            F.when(F.isnan(weight) | (F.abs(weight) == float("inf")), 0.7).otherwise(weight).alias("importance"), col("timestamp_ms", F.lit(now_ms)).alias("timestamp_ms"), col("metadata", F.lit("{}")).alias("metadata"),
            F.expr("uuid()").alias("row"), *(c for c in ("file", "taken") if c in have),
        )
        return full.where(F.assert_true(F.size("vector") == self.dim).isNull()) if self.dim else full

    def append(self, rows: DataFrame, now_ms: int) -> None:
        """Adds entries. Equal texts are entries of their own; ids that are given are kept."""
        self._add(self.completed(rows, now_ms))

    def put_files(self, rows: DataFrame, files: DataFrame, now_ms: int) -> None:
        """Adds the entries of files (`file`) in place of those that these files gave before, in one append, so it can be repeated after a failure."""
        old = self.live().where("file is not null").join(files.select("file").distinct(), "file", "left_semi")
        self._add(self.completed(rows, now_ms).unionByName(self._removal(old), allowMissingColumns=True))

    @staticmethod
    def _removal(rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(None).cast("string").alias("id"), F.col("row").alias("replaces"))

    def get(self, wanted: str, scopes: list[str] | None = None) -> DataFrame:
        return self._found(wanted, scopes).select(*MEMORY.fieldNames())

    def _found(self, wanted: str, scopes: list[str] | None = None) -> DataFrame:
        found = by_prefix(self.live(), wanted)
        ids = {r.id for r in found.select("id").distinct().limit(2).collect()}
        if len(ids) > 1:
            raise ValueError(f"ambiguous id prefix: {wanted}")
        if ids and scopes and not found.where(scope_predicate(scopes)).count():
            raise PermissionError(f"outside of scopes: {wanted}")
        return found

    def delete(self, wanted: str, scopes: list[str] | None = None) -> bool:
        return bool(self._remove(self._found(wanted, scopes)))

    def _remove(self, rows: DataFrame) -> int:
        n = rows.count()
        if n:
            self._add(self._removal(rows))
        return n

    def update(self, wanted: str, **patch) -> bool:
        found = self._found(wanted)
        if not found.count():
            return False
        new = found.withColumns({k: F.lit(v) for k, v in patch.items() if v is not None})
        self._add(new.withColumn("replaces", F.col("row")).withColumn("row", F.expr("uuid()")))
        return True

    def bulk_delete(self, scopes: list[str] | None = None, before_ms: int | None = None) -> int:
        return self.bulk_delete_where(bulk_condition(scopes, before_ms))

    def bulk_delete_where(self, condition: Column) -> int:
        return self._remove(self.live().where(condition))

    def ledger(self) -> DataFrame:
        """The last mark of every file that was taken in."""
        all_marks = self._folder("ledger", LEDGER)
        last = all_marks.withColumn("_n", F.row_number().over(W.partitionBy("path").orderBy(F.desc("ingested_at"), F.desc("mtime_ms"))))
        return last.where("_n = 1").drop("_n")

    def mark(self, files: DataFrame) -> None:
        files.select(*(c.split()[0] for c in LEDGER.split(", "))).write.mode("append").parquet(f"{self.path}/ledger")

    def staged(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """(rows as a table of their own, its path), so that what they were read from is read once."""
        path = f"{self.path}/intake/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), path

    def forget(self, path: str) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def reset(self) -> None:
        self._fs.delete(self._fs_path, True)


def by_prefix(df: DataFrame, wanted: str) -> DataFrame:
    """Rows of a full id, or of a hexadecimal prefix of eight or more characters."""
    if re.fullmatch(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", wanted):
        return df.where(F.col("id") == wanted)
    if re.fullmatch(r"(?i)[0-9a-f]{8,}", wanted):
        return df.where(F.col("id").startswith(wanted))
    raise ValueError(f"not an id: {wanted}")


def bulk_condition(scopes: list[str] | None = None, before_ms: int | None = None) -> Column:
    if not scopes and before_ms is None:
        raise ValueError("bulk delete needs scopes or a time")
    gone = scope_predicate(scopes) if scopes else F.lit(True)
    if before_ms is not None:
        gone = gone & (F.col("timestamp_ms") < before_ms)
    return F.coalesce(gone, F.lit(False))


def bulk_delete(df: DataFrame, scopes: list[str] | None = None, before_ms: int | None = None) -> DataFrame:
    return df.where(~bulk_condition(scopes, before_ms))


def patched(df: DataFrame, patch: DataFrame, fields: list[str]) -> DataFrame:
    """df with the non-null fields of patch (by id)."""
    p = patch.select("id", *(F.col(c).alias(f"_{c}") for c in fields))
    return df.join(p, "id", "left").select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns))


def stats(df: DataFrame) -> DataFrame:
    """kind, value, n: all rows, and by scope and category, in one pass."""
    g = df.select(F.coalesce("scope", F.lit("global")).alias("scope"), "category").groupingSets([["scope"], ["category"], []], "scope", "category").agg(F.count(F.lit(1)).alias("n"), F.grouping_id("scope", "category").alias("g"))
    return g.select(F.when(F.col("g") == 1, "scope").when(F.col("g") == 2, "category").otherwise("total").alias("kind"), F.when(F.col("g") == 1, F.col("scope")).when(F.col("g") == 2, F.col("category")).otherwise("").alias("value"), "n")


def list_recent(df: DataFrame, limit: int = 20, offset: int = 0, scopes: list[str] | None = None, category: str | None = None) -> DataFrame:
    kept = df.where(scope_predicate(scopes))
    if category:
        kept = kept.where(F.col("category") == category)
    return kept.orderBy(F.desc(F.coalesce("timestamp_ms", F.lit(0))), "id").offset(offset).limit(limit)


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """files (path, size, mtime_ms) that the ledger does not hold with the same size, and time where both are known."""
    last = ledger.withColumn("_n", F.row_number().over(W.partitionBy("path").orderBy(F.desc("ingested_at")))).where("_n = 1")
    known = last.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("mtime_ms").alias("_m"))
    same = (F.col("path") == F.col("_p")) & (F.col("size") == F.col("_s")) & (F.col("mtime_ms").isNull() | F.col("_m").isNull() | (F.col("mtime_ms") == F.col("_m")))
    return files.join(known, same, "left_anti")
