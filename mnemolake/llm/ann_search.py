"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard, kept as flat arrays.

Equal vectors are one node, so copies cannot wall off a graph; nodes are dealt to shards of bounded size by a hash of
their vectors. Each shard's graph is built by one task: nodes get a level with geometric chances, every layer links a
node to close ones that differ in direction, and nodes are inserted a batch at a time, the batch's own members
standing among the candidates. Queries go to all shards in blocks, the shards' best are scored in double precision on
the original vectors and merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hot, looked_up, scratch, table, written

#: Nodes of a shard on average; a shard's graph and vectors are held by one task.
SHARD_ROWS = 8192
#: Neighbours of a node in the layers above the lowest, which holds twice as many.
LINKS = 16
#: Nodes that a search keeps in view while a graph is built, and when it is asked.
BUILD_VIEW, SEARCH_VIEW = 96, 192
#: Queries that meet a shard at once.
BLOCK = 2048
#: Nodes inserted at once at most; the first so many of a layer are compared with each other.
BATCH = 256
#: Nodes of each query whose neighbours are looked at in one step.
WIDE = 4


def scaled(flat: np.ndarray, dim: int) -> np.ndarray:
    """Vectors in double precision, each times a power of two, so that squares neither vanish nor overflow."""
    v = flat.astype(np.float64).reshape(-1, dim)
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1]) if len(v) else v


def unit(v: np.ndarray) -> np.ndarray:
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def nearest(points: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, view: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the `view` nearest nodes that a walk along links from `start` finds, with their products, nearest first (-1: none)."""
    count = len(queries)
    ids = np.full((count, view), -1, np.int32)
    near = np.full((count, view), -np.inf, np.float32)
    done = np.ones((count, view), bool)
    ids[:, 0], near[:, 0], done[:, 0] = start, (points[start] * queries).sum(1), False
    seen = np.zeros((count, len(links) + 1), bool)  # the last column stands for no node
    seen[:, -1] = True
    seen[np.arange(count), start] = True
    rows = np.arange(count)
    wide = min(WIDE, view)
    while len(rows):
        pick = np.argsort(done[rows], axis=1, kind="stable")[:, :wide]
        at = rows[:, None]
        taken = ~done[at, pick]
        alive = taken.any(1)
        rows, pick, taken = rows[alive], pick[alive], taken[alive]
        if not len(rows):
            break
        at = rows[:, None]
        done[at, pick] = True
        nodes = links[ids[at, pick]]
        nodes[~taken] = -1
        nodes = np.sort(nodes.reshape(len(rows), -1), axis=1)[:, ::-1]
        fresh = ~seen[at, nodes]
        fresh[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
        most = int(fresh.sum(1).max())
        if not most:
            continue
        nodes = np.sort(np.where(fresh, nodes, -1), axis=1)[:, : -most - 1 : -1]
        seen[at, nodes] = True
        close = np.matmul(points[nodes], queries[rows][:, :, None])[:, :, 0]
        close[nodes < 0] = -np.inf
        all_ids, all_near = np.concatenate((ids[rows], nodes), 1), np.concatenate((near[rows], close), 1)
        all_done = np.concatenate((done[rows], nodes < 0), 1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :view]
        take = lambda x: np.take_along_axis(x, order, 1)  # noqa: B023, E731
        ids[rows], near[rows], done[rows] = take(all_ids), take(all_near), take(all_done)
    return ids, near


def chosen(points: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (-1: none; a node may stand twice) up to `most`: those nearer to the row's node than to any chosen before, then the nearest others."""
    out = np.full((len(ids), most), -1, np.int32)
    for a in range(0, len(ids), 512):
        own, close = ids[a : a + 512], near[a : a + 512]
        by_id = np.argsort(own, axis=1, kind="stable")
        same = np.take_along_axis(own, by_id, 1)
        twice = np.zeros(own.shape, bool)
        np.put_along_axis(twice, by_id[:, 1:], same[:, 1:] == same[:, :-1], 1)
        close = np.where((own < 0) | twice, -np.inf, close)
        order = np.argsort(-close, axis=1, kind="stable")
        own, close = np.take_along_axis(own, order, 1), np.take_along_axis(close, order, 1)
        there = np.isfinite(close)
        width = max(1, int(there.sum(1).max(initial=0)))
        own, close, there = own[:, :width], close[:, :width], there[:, :width]
        vectors = points[own]
        between = np.matmul(vectors, vectors.transpose(0, 2, 1))
        picked = np.zeros(own.shape, bool)
        for c in range(width):
            picked[:, c] = there[:, c] & ~((between[:, c] > close[:, c, None]) & picked).any(1)
        rank = np.argsort(np.where(picked, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
        kept = np.where(np.take_along_axis(there, rank, 1), np.take_along_axis(own, rank, 1), -1)
        out[a : a + 512, : kept.shape[1]] = kept
    return out


def link_back(points: np.ndarray, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    """Tells each target of its new source; a node that has no room keeps the best choice of all."""
    most = links.shape[1]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target, "left")
    for turn in range(0, int(place.max(initial=-1)) + 1, most):
        now = (place >= turn) & (place < turn + most)
        nodes, row = np.unique(target[now], return_inverse=True)
        more = np.full((len(nodes), int(place[now].max()) - turn + 1), -1, np.int32)
        more[row, place[now] - turn] = source[now]
        ids = np.concatenate((links[nodes], more), 1)
        for a in range(0, len(nodes), 1024):
            near = np.matmul(points[ids[a : a + 1024]], points[nodes[a : a + 1024]][:, :, None])[:, :, 0]
            links[nodes[a : a + 1024]] = chosen(points, ids[a : a + 1024], near, most)


def entries(points: np.ndarray, upper: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Where a search of the layer below `upper` (lowest first) begins for each query; node 0 stands in all layers."""
    start = np.zeros(len(queries), np.int64)
    for links in reversed(upper):
        start = nearest(points, links, queries, start, 8)[0][:, 0].astype(np.int64)
    return start


def layer(points: np.ndarray, count: int, most: int, upper: list[np.ndarray], view: int = BUILD_VIEW) -> np.ndarray:
    """The neighbours of the first `count` nodes in one layer, `upper` being the layers above it."""
    links = np.full((count, most), -1, np.int32)
    made = 0
    while made < count:
        stop = min(count, made + (min(BATCH, made) if made else BATCH))
        own = points[made:stop]
        near = own @ own.T
        np.fill_diagonal(near, -np.inf)
        ids = np.broadcast_to(np.arange(made, stop, dtype=np.int32), near.shape)
        if near.shape[1] > view:
            best = np.argpartition(-near, view, axis=1)[:, :view]
            near, ids = np.take_along_axis(near, best, 1), np.take_along_axis(ids, best, 1)
        if made:
            start = entries(points, upper, own)
            found, close = nearest(points, links[:made], own, np.where(start < made, start, 0), view)
            near, ids = np.concatenate((close, near), 1), np.concatenate((found, ids), 1)
        order = np.argsort(-near, axis=1, kind="stable")[:, :view]
        near, ids = np.take_along_axis(near, order, 1), np.take_along_axis(ids, order, 1)
        new = chosen(points, np.where(np.isfinite(near), ids, -1), near, LINKS)
        links[made:stop, :LINKS] = new
        source, target = np.repeat(np.arange(made, stop, dtype=np.int32), LINKS), new.ravel()
        link_back(points, links, source[target >= 0], target[target >= 0])
        made = stop
    return links


def graph(points: np.ndarray, levels: np.ndarray) -> list[np.ndarray]:
    """The layers, lowest first, of nodes that stand in falling order of their levels."""
    upper: list[np.ndarray] = []
    for level in range(int(levels[0]), -1, -1):
        upper.insert(0, layer(points, int((levels >= level).sum()), LINKS * (2 if level == 0 else 1), upper))
    return upper


def levels_of(h: np.ndarray) -> np.ndarray:
    """Levels by a hash: each is LINKS times as rare as the one below."""
    share = ((h.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return np.floor(-np.log(share) / math.log(LINKS)).astype(np.int64)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _build(kind: str):
    def run(group: pa.Table) -> pa.Table:
        dim, shard = group["dim"][0].as_py(), group["shard"][0].as_py()
        h1, h2 = (group[c].to_numpy().astype(np.int64) for c in ("h1", "h2"))
        levels = levels_of(h2)
        order = np.lexsort((h2, h1, -levels))
        original = _flat(group["embedding"]).reshape(-1, dim)[order]
        layers = graph(unit(scaled(original, dim)), levels[order])
        value = pa.float32() if kind == "array<float>" else pa.float64()
        listed = lambda x, t: pa.array([x], pa.list_(t))
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "h1": listed(h1[order], pa.int64()), "h2": listed(h2[order], pa.int64()), "vectors": listed(original.ravel(), value), "layers": listed(np.array([len(x) for x in layers], np.int32), pa.int32()), "links": listed(np.concatenate([x.ravel() for x in layers]), pa.int32())})

    return run


def unpacked(sizes: np.ndarray, flat: np.ndarray) -> list[np.ndarray]:
    """The layers from their sizes and the flat array of all neighbours."""
    out, at = [], 0
    for level, n in enumerate(sizes.tolist()):
        width = LINKS * (2 if level == 0 else 1)
        out.append(flat[at : at + n * width].reshape(n, width))
        at += n * width
    return out


def _search(k: int, view: int):
    names = ["q1", "q2", "h1", "h2", "score"]
    types = [pa.int64()] * 4 + [pa.float64()]

    def run(asked: pa.Table, index: pa.Table) -> pa.Table:
        if not asked.num_rows or not index.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types)})
        dim = index["dim"][0].as_py()
        vectors = scaled(_flat(index["vectors"]), dim)
        points = unit(vectors)
        layers = unpacked(_flat(index["layers"]), _flat(index["links"]))
        h1, h2 = _flat(index["h1"]), _flat(index["h2"])
        queries = scaled(_flat(asked["embedding"]), dim)
        size = np.sqrt((vectors * vectors).sum(1))
        most = min(k, len(points))
        row, node, score = [], [], []
        step = max(16, min(256, (1 << 25) // len(points)))
        for a in range(0, len(queries), step):
            q = queries[a : a + step]
            own = unit(q)
            ids = nearest(points, layers[0], own, entries(points, layers[1:], own), max(view, k))[0]
            there = ids >= 0
            cosine = (vectors[ids] * q[:, None, :]).sum(2) / (size[ids] * np.sqrt((q * q).sum(1))[:, None])
            cosine[~there] = -np.inf
            order = np.argsort(-cosine, axis=1, kind="stable")[:, :most]
            kept = np.take_along_axis(there, order, 1)
            row.append(np.repeat(np.arange(a, a + len(q)), most).reshape(-1, most)[kept])
            node.append(np.take_along_axis(ids, order, 1)[kept])
            score.append(np.take_along_axis(cosine, order, 1)[kept])
        row, node, score = map(np.concatenate, (row, node, score))
        return pa.table({"q1": asked["h1"].take(pa.array(row)), "q2": asked["h2"].take(pa.array(row)), "h1": pa.array(h1[node]), "h2": pa.array(h2[node]), "score": pa.array(score)})

    return run


def usable(embeddings: DataFrame, asked: Column) -> DataFrame:
    """(row, vec_id, asked, dim, h1, h2, embedding) of the vectors that take part; h1 and h2 tell vectors apart, row tells rows apart."""
    kind = embeddings.schema["embedding"].dataType.simpleString()
    vec = F.col("embedding").cast(kind if kind == "array<float>" else "array<double>")
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    base = embeddings.where(good).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(asked, F.lit(False)).alias("asked"), vec.alias("embedding"))
    return base.select("row", "vec_id", "asked", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"), "embedding")


def build_index(spark: SparkSession, rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard and vector length of the different vectors of rows (as of usable(), written): dim, shard, h1, h2, vectors, layers, links."""
    kind = rows.schema["embedding"].dataType.simpleString()
    nodes = rows.groupBy("h1", "h2").agg(F.first("dim").alias("dim"), F.first("embedding").alias("embedding"))
    shards = max(1, math.ceil(rows.select("h1", "h2").distinct().count() / shard_rows))
    dealt = nodes.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).repartition(min(shards, 10_000), "dim", "shard")
    schema = f"dim int, shard int, h1 array<long>, h2 array<long>, vectors {kind}, layers array<int>, links array<int>"
    return dealt.groupBy("dim", "shard").applyInArrow(_build(kind), schema)


def search(spark: SparkSession, index: DataFrame, queries: DataFrame, k: int, view: int = SEARCH_VIEW, block: int = BLOCK) -> DataFrame:
    """The k nearest vectors (q1, q2, h1, h2, score) that each shard of index (written) finds for each of the different queries (dim, h1, h2, embedding; written)."""
    blocks = max(1, math.ceil(queries.count() / block))
    pairs = index.select("dim", "shard")
    last = pairs.agg(F.max("shard")).first()[0]
    asked = queries.withColumn("block", F.pmod("h2", F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last or 0))))
    met = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    n = min(((last or 0) + 1) * blocks, 10_000)
    left, right = (x.repartition(n, *keys).groupBy(*keys) for x in (asked, met))
    return left.cogroup(right).applyInArrow(_search(k, view), "q1 long, q2 long, h1 long, h2 long, score double")


def neighbours(spark: SparkSession, embeddings: DataFrame, asked: Column, k: int = 5, shard_rows: int = SHARD_ROWS, view: int = SEARCH_VIEW, block: int = BLOCK) -> DataFrame:
    """For each row of embeddings (vec_id, embedding) that `asked` holds for, its k nearest other rows by cosine: query_id, rank, vec_id, score.

    Ties go to the smaller vec_id; scores are cosines of the original vectors in double precision. Vectors that are
    null, empty, zero or hold a null or non-finite component take no part; vectors of other lengths are no candidates.
    Rows with equal vectors are all indexed and found; rows with one vec_id are different rows, each asked or found by itself, and
    null ids come last among ties. If fewer than k others exist, all are returned; an empty table gives no rows. Other
    columns are ignored.
    """
    with scratch(spark) as write:
        rows = write(usable(embeddings, asked), "vectors")
        index = write(build_index(spark, rows, shard_rows), "graphs")
        wanted = rows.where("asked")
        classes = write(wanted.groupBy("h1", "h2").agg(F.first("dim").alias("dim"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies")), "queries")
        found = write(search(spark, index, classes.select("dim", "h1", "h2", "embedding"), k + 1, view, block), "found")
        own = Window.partitionBy("q1", "q2")
        best = found.withColumn("n", F.rank().over(own.orderBy(F.desc("score")))).where(F.col("n") <= k + 1)
        low = rows.select("h1", "h2", "row", "vec_id").withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("vec_id"), "row"))).where(F.col("n") <= k + 1)
        each = best.drop("n").join(low.drop("n"), ["h1", "h2"])
        each = each.withColumn("n", F.row_number().over(own.orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))).where(F.col("n") <= k + 1)
        answers = each.groupBy(F.col("q1").alias("h1"), F.col("q2").alias("h2")).agg(F.sort_array(F.collect_list(F.struct("n", "row", "vec_id", "score"))).alias("near"))
        answers = write(answers.join(classes.select("h1", "h2", "copies"), ["h1", "h2"]), "answers")
        told = looked_up(wanted.select("row", "vec_id", "h1", "h2"), answers, ["h1", "h2"], F.col("copies") > hot(wanted.count()))
        others = F.slice(F.filter("near", lambda x: x["row"] != F.col("row")), 1, k)
        out = told.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "x"))
        return written(spark, out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")), "neighbours")


def op12_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op12_ann_search": op12_ann_search}
#: Of the exact search; the rows agree where all true neighbours are found, as on the small tables (recall of larger ones: README).
SQL = {
    "op12_ann_search": """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
ok AS MATERIALIZED (SELECT rid, vec_id, v FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
near AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.v, b.v) AS score FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM near)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
}
