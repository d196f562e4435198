"""Near duplicates among embeddings: Euclidean p-stable hashing proposes, exact cosines in double precision decide.

Unit vectors are hashed by quantised Gaussian projections, floor((a.v + b) / w), several to a table. A cosine c
is a distance sqrt(2 - 2c), which fixes the chance that one projection agrees; the number of projections a table
follows from how many vectors there are, and the number of tables from the recall asked for. Tables are taken in
turns, so what is shuffled at once does not grow with their number, and only vectors travel: the buckets that two
similar vectors have in earlier tables are computed again where they meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot, looked_up, runs, scratch, table, written
from .ngram_join import PLACE, group_facts, links_of, part_pairs

THRESHOLD = 0.9
WIDTH = 2.0
#: Chance that all tables miss a pair whose cosine is the threshold itself; closer pairs are missed far more rarely.
MISS = 1e-4
#: Vectors that a bucket of unrelated ones holds on average.
BUCKET = 1024
#: Vectors that a task compares with as many others at once.
BLOCK = 4096
#: Tables that one shuffle takes.
TURN = 32


def agreement(cosine: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection of two unit vectors of this cosine agrees."""
    r = width / math.sqrt(max(1e-12, 2 - 2 * cosine))
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, threshold: float = THRESHOLD, miss: float = MISS, bucket: int = BUCKET) -> tuple[int, int]:
    """(projections a table, tables) for n vectors, so that unrelated ones share a bucket with about `bucket` others."""
    k = max(1, math.ceil(math.log(max(1.0, n / bucket)) / -math.log(agreement(0.0))))
    return k, max(1, math.ceil(math.log(miss) / math.log1p(-agreement(threshold) ** k)))


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.sqrt((v * v).sum(1, keepdims=True))


class Tables:
    """The buckets of unit vectors of one length in all tables: 64-bit keys, alike wherever and with whatever others they are computed."""

    def __init__(self, dim: int, k: int, tables: int):
        rng = np.random.default_rng(1000 + dim)
        self.a, self.b = rng.normal(0, 1, (dim, k * tables)), rng.uniform(0, WIDTH, k * tables)
        self.mix = rng.integers(0, 1 << 63, k, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.k, self.salt = k, dim

    def keys(self, u: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Of tables start to stop. The sums run over the components one by one, so that no other row or table sways their rounding."""
        cols = slice(start * self.k, stop * self.k)
        out = np.tile(self.b[cols], (len(u), 1))
        for j in range(u.shape[1]):
            out += u[:, j : j + 1] * self.a[j, cols]
        cells = np.floor(out / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(u), stop - start, self.k)
        h = (cells * self.mix).sum(2, dtype=np.uint64) + (np.arange(start, stop, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(self.salt)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def _vectors(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _by_length(batch, sizes: np.ndarray) -> Iterator[tuple[int, object]]:
    for dim in np.unique(sizes).tolist():
        yield dim, batch.filter(pa.array(sizes == dim))


def _lengths(column) -> np.ndarray:
    return column.value_lengths().to_numpy() if isinstance(column, pa.Array) else column.combine_chunks().value_lengths().to_numpy()


def _keys(k: int, tables: int, start: int, stop: int):
    """Each vector's buckets in the tables of a turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Tables] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                for dim, part in _by_length(some, _lengths(some.column("embedding"))):
                    own = known.setdefault(dim, Tables(dim, k, tables) if dim not in known else known[dim])
                    keys = own.keys(_vectors(part.column("embedding"), dim), start, stop)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, stop - start), pa.int32()), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([*part.columns, flat], [*part.schema.names, "keys"])

    return run


def _compare(threshold: float, k: int, tables: int):
    """A pair counts in the first table in which its buckets agree, so no table needs to know what others found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Tables] = {}
        for whole in runs(batches, *PLACE):
            for dim, part in _by_length(whole, _lengths(whole["embedding"])):
                own = known.setdefault(dim, Tables(dim, k, tables) if dim not in known else known[dim])
                node, copies, side = (part[c].to_numpy() for c in ("node", "copies", "own"))
                i, j, tab = (part[c][0].as_py() for c in ("i", "j", "tab"))
                u = _vectors(part["embedding"], dim)
                left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
                pairs: list[tuple[np.ndarray, np.ndarray]] = []
                for at in range(0, len(left), 512):
                    rows = left[at : at + 512]
                    p, q = np.nonzero(u[rows] @ u[right].T >= threshold)
                    a, b = rows[p], right[q]
                    if i == j:
                        a, b = a[a < b], b[a < b]
                    pairs.append((a, b))
                a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
                if not len(a):
                    continue
                used, back = np.unique(np.concatenate((a, b)), return_inverse=True)
                keys = own.keys(u[used], 0, tab + 1)
                new = np.zeros(len(a), bool)
                for at in range(0, len(a), 1 << 16):
                    x, y = keys[back[: len(a)][at : at + (1 << 16)]], keys[back[len(a) :][at : at + (1 << 16)]]
                    new[at : at + (1 << 16)] = ~(x[:, :tab] == y[:, :tab]).any(1) & (x[:, tab] == y[:, tab])
                if new.any():
                    yield links_of(node, copies, a[new], b[new])

    return run


def near_duplicates(spark: SparkSession, embeddings: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK, bucket: int = BUCKET, turn: int = TURN) -> DataFrame:
    """One row per vector (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing; vectors of
    different lengths never link. Equal vectors are one class from the start (told apart by 128-bit hashes) and count as
    links of each other. Repeated vec_ids count as different vectors. Other columns are ignored; an empty table gives no
    rows. A bucket beyond `block` vectors is cut into parts, and every two parts are compared by one task.
    """
    kind = embeddings.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    vec = F.col("embedding").cast(kind)
    usable = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    base = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, vec).alias("embedding"))
    named = base.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    with scratch(spark) as write:
        ids = write(named.select("vec_id", "h1", "h2", F.col("embedding").isNotNull().alias("usable")), "vectors")
        classes = named.where("embedding is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
        classes = write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        k, tables = parameters(classes.count(), threshold, miss, bucket)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        links = None
        for start in range(0, tables, turn):
            stop = min(tables, start + turn)
            hashed = classes.select("node", "copies", "embedding").mapInArrow(_keys(k, tables, start, stop), f"node long, copies long, embedding {kind}, keys array<long>")
            each = hashed.select("node", "copies", "embedding", F.posexplode("keys").alias("tab", "key"))
            sizes = write(each.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block), "buckets")
            # so many rows hold a bucket of more than `block`, so there are few such buckets
            parts = each.join(F.broadcast(sizes) if sizes.count() <= 1_000_000 else sizes, "key", "left").select("node", "copies", "embedding", "key", (F.col("tab") + start).alias("tab"), F.coalesce(F.ceil(F.col("m") / block), F.lit(1)).cast("int").alias("parts"))
            faced = parts.withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int")).select("node", "copies", "embedding", "key", "tab", "own", F.explode(part_pairs(F.col("parts"), F.col("own"))).alias("p")).select("node", "copies", "embedding", "key", "tab", "own", "p.i", "p.j")
            found = write(faced.repartition(n, *PLACE).sortWithinPartitions(*PLACE).mapInArrow(_compare(threshold, k, tables), "node long, links long, root long"), "links")
            links = found if links is None else links.unionByName(found)
        facts = write(group_facts(spark, classes, links, write), "facts")
        told = looked_up(ids.where("usable").select("vec_id", "h1", "h2"), facts, ["h1", "h2"], F.col("copies") > hot(ids.count())).select("vec_id", "n_links", F.col("group_id").alias("component_id"))
        alone = ids.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        out = written(spark, told.unionByName(alone), "components")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))


_UNIT = "SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings"
QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
SQL = {
    "op6_embedding_dedup": f"""
WITH RECURSIVE e AS MATERIALIZED ({_UNIT}),
ok AS MATERIALIZED (SELECT rid, vec_id, CAST(v AS DOUBLE[64]) AS v FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b, b.vec_id AS other FROM ok a JOIN ok b ON a.rid <> b.rid AND array_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT rid, rid FROM e UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT reach.a AS rid, min(e.vec_id) AS component_id FROM reach JOIN e ON reach.b = e.rid GROUP BY reach.a),
deg AS (SELECT a AS rid, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, comp.component_id, e.vec_id = comp.component_id AS kept
FROM e JOIN comp USING (rid) LEFT JOIN deg USING (rid)
"""
}
