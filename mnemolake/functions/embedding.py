"""Embedders: any callable from texts to vectors, run in Arrow batches; an offline one hashes n-grams."""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, streamed
from .chunking import ChunkConfig, chunk, for_model
from .text import cache_key

Embedder = Callable[[list[str]], list[list[float]]]
BATCH = 32
CACHED = "key string, vector array<float>, made_ms long"


def hash_embedder(dim: int = 64) -> Embedder:
    """Character trigrams hashed with signs to unit vectors; deterministic and offline."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v, low = [0.0] * dim, f" {t.lower()} "
            for i in range(len(low) - 2):
                h = zlib.crc32(low[i : i + 3].encode("utf-8", "surrogatepass"))
                v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return embed


#: What an embedder's error says where a text is beyond its context.
REFUSED = re.compile("context|too long|exceed|length", re.I)


def or_parts(embedder: Embedder, model: str) -> Embedder:
    """An embedder that cuts only the texts which `embedder` refuses for their length, as the model's context asks, and gives the mean of the parts.

    A batch that is refused is asked again text by text; a part that is refused is cut again while that makes it shorter.
    Other errors, and that of a text which cannot be cut, pass.
    """
    cfg = for_model(model)

    def one(text: str, own: ChunkConfig) -> list[float]:
        try:
            return embedder([text])[0]
        except Exception as e:
            parts = [c for c, _, _ in chunk(text, own)] if REFUSED.search(str(e)) else []
            if not parts or parts == [text] and own.size <= 2:
                raise
            smaller = replace(own, size=max(2, own.size // 2), overlap=own.overlap // 2, least=max(1, own.least // 2))
            found = [one(p, smaller) for p in parts]
            return [sum(x) / len(found) for x in zip(*found)]

    def embed(texts: list[str]) -> list[list[float]]:
        try:
            return embedder(texts)
        except Exception as e:
            if not REFUSED.search(str(e)):
                raise
            return [one(t, cfg) for t in texts]

    return embed


def with_vectors(df: DataFrame, embedder: Embedder, column: str = "text", long_texts: ChunkConfig | None = None, dim: int | None = None) -> DataFrame:
    """df with a vector column; empty texts get an empty vector, texts beyond long_texts.size the mean of their chunks'."""

    def one(texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = [[] for _ in texts]
        for i in range(0, len(texts), BATCH):
            some = [j for j in range(i, min(i + BATCH, len(texts))) if texts[j] and texts[j].strip()]
            plain = [j for j in some if not long_texts or len(texts[j]) <= long_texts.size]
            for j, v in zip(plain, embedder([texts[j] for j in plain]) if plain else []):
                out[j] = v
            for j in set(some) - set(plain):
                parts = embedder([c for c, _, _ in chunk(texts[j], long_texts)])
                out[j] = [sum(x) / len(parts) for x in zip(*parts)]
        for v in out:
            if dim and v and len(v) != dim:
                raise ValueError(f"a vector has {len(v)} components, not {dim}")
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = one([t or "" for t in batch.column(column).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float32()))], [*batch.schema.names, "vector"])

    return streamed(df, run, T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))


def with_cached_vectors(df: DataFrame, cache: DataFrame, embedder: Embedder, task: str = "passage") -> tuple[DataFrame, DataFrame]:
    """(df with vectors, new cache rows (key, vector)); only texts whose key is not in the cache are embedded."""
    keyed = df.withColumn("cache_key", cache_key(task, F.col("text")))
    known = cache.select(F.col("key").alias("cache_key"), "vector")
    fresh = with_vectors(keyed.join(known, "cache_key", "left_anti").select("cache_key", "text").dropDuplicates(["cache_key"]), embedder).select("cache_key", "vector")
    return keyed.join(known.unionByName(fresh), "cache_key").drop("cache_key"), fresh.withColumnRenamed("cache_key", "key")


class VectorCache:
    """Vectors of texts under path, by embedder and task; those older than max_age_ms are made again.

    Misses are embedded once for each different text and written before anything uses them, so a run that breaks off does
    not embed again what it had. `vectors` tells how many texts it embedded; hits are the rest.
    """

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder, now_ms: int, dim: int | None = None, max_age_ms: int | None = None, task: str = "passage"):
        self.spark, self.path, self.embedder, self.now_ms, self.dim, self.max_age_ms, self.task = spark, path, embedder, now_ms, dim, max_age_ms, task

    def _known(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        rows = self.spark.read.schema(CACHED).parquet(self.path) if there else self.spark.createDataFrame([], CACHED)
        fresh = rows if self.max_age_ms is None else rows.where(F.col("made_ms") > self.now_ms - self.max_age_ms)
        return fresh.groupBy("key").agg(F.max_by("vector", "made_ms").alias("vector"))

    def vectors(self, df: DataFrame) -> tuple[DataFrame, int]:
        """(df with the vectors of its texts, number of texts that were embedded); a null or empty text has an empty vector. df is read twice."""
        keyed = df.withColumn("_key", cache_key(self.task, F.coalesce("text", F.lit(""))))
        misses = keyed.join(self._known(), F.col("_key") == F.col("key"), "left_anti").groupBy("_key").agg(F.first("text").alias("text"))
        count = Observation(f"embedded-{uuid.uuid4().hex}")
        made = with_vectors(misses, self.embedder, dim=self.dim).select(F.col("_key").alias("key"), "vector", F.lit(self.now_ms).cast("long").alias("made_ms"))
        made.observe(count, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(self.path)
        return keyed.join(self._known().withColumnRenamed("key", "_key"), "_key").drop("_key"), count.get["n"]


def mean_vectors(df: DataFrame, key: str, column: str = "vector") -> DataFrame:
    parts = df.select(key, F.posexplode(column).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))
