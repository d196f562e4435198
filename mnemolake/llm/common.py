"""What the operators share: tables, the shared folder, grouping in sorted partitions, components."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch between a task and its Python worker at most: both sides hold a few batches at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
#: Rows of a side of a join that may be broadcast: two longs each, so 32 MB at most.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is set only for a local master (tests) where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "mnemolake-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and outlives any executor."""
    path = f"{shared_dir(spark)}/mnemolake/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._mnemolake_path = path
    return out


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing lazy depends on it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(df._mnemolake_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a written() whose tables are deleted at the end; what leaves the block must be written outside of it."""
    tables: list[DataFrame] = []

    def write(df: DataFrame, tag: str) -> DataFrame:
        tables.append(written(spark, df, tag))
        return tables[-1]

    try:
        yield write
    finally:
        for t in tables:
            forget(spark, t)


def fresh_names(taken: list[str], *names: str) -> list[str]:
    """names with as many underscores before them as none of the taken ones begins with, whatever their case."""
    mark = "_"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return [mark + n for n in names]


def streamed(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches that BATCH bounds; a session's own lower bounds stay."""
    conf = df.sparkSession.conf
    for key, most in BATCH.items():
        now = conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df.mapInArrow(run, schema)


_cached: list[Callable] = []


def keep_only(clear: Callable | None = None) -> None:
    """Says in a worker process whose caches are in use (by what clears them, if any); those of other operators are cleared."""
    if _cached and _cached[0] != clear:
        _cached[0]()
    _cached[:] = [clear] if clear else []


def give_back() -> None:
    """Returns to the system what a fit has freed, which allocators would keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None  # glibc alone has it
    if trim:
        trim(0)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to be small; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The groups of equal (integer) keys of a partition that is sorted by them, one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
        cut = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut, cut[1:]):
            own = tuple(cols[:, a].tolist())
            if own != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = own
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def hot(rows: int) -> int:
    """Rows of a key from which it counts as hot, so that there are at most a million hot keys, and fewer on small tables."""
    return max(200, rows // 1_000_000 + 1)


def looked_up(big: DataFrame, facts: DataFrame, keys: list[str], often: Column, how: str = "inner") -> DataFrame:
    """big joined to facts, which has one row a key; the keys that `often` marks as hot are broadcast and not shuffled by.

    facts is read several times, so it should be a written table; no key is null.
    """
    few = F.broadcast(facts.where(often))
    rest = big.join(F.broadcast(facts.where(often).select(*keys)), keys, "left_anti").join(facts.where(~often), keys, how)
    both = big.join(few, keys)
    return both.unionByName(rest.select(*both.columns))


def tied(pairs: DataFrame, by: str, write: Callable, rows: int) -> DataFrame:
    """pairs (u, v) with m, the least v of each u (`by` gives least(u, m) as well as m alone): hot nodes are broadcast."""
    low = write(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg")), "low")
    facts = low.select("u", (F.least("u", "m") if by == "least" else F.col("m")).alias("m"), "deg")
    return looked_up(pairs, facts, ["u"], F.col("deg") > hot(rows)).drop("deg")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) of the undirected edges (u, v) of longs, root being the smallest node reached.

    Alternates the large-star and small-star steps until the edges stay the same; every round is written
    to the shared folder, and only a count and a checksum come to the driver. Nodes with very many neighbours are joined
    by broadcast, so none gathers in one task. Nodes of no edge have no row.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = written(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = state(now)
    while before[0]:
        with scratch(spark) as write:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = write(tied(both, "least", write, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
            small_star = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
            after = written(spark, tied(large, "m", write, before[0]).select(F.explode(small_star).alias("e")).select("e.*").where("u <> v").distinct(), "cc")
        forget(spark, now)
        now, was, before = after, before, state(after)
        if was == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
