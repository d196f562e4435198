"""The prefix trie of conversations, with sums over subtrees by heavy paths.

A prefix is known by 128 bits: the exclusive or, from the first turn on, of hashes of each turn and its place. A node's
heavy child is the one with most members, so a way down from the root leaves a heavy path at most log2(members) times. Each node knows
its path's top and how many light edges lie above it; sums run up along the paths of one level at a time, deepest
first, and each path's total is then added to the node it hangs from. Running folds are taken in blocks, so neither
a long conversation nor a long path gathers in one task; texts never move, only their hashes and lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hot, looked_up, scratch, streamed, table, written

#: Rows that a running fold takes in one window.
BLOCK = 1024
#: Ids that stand in one piece of text on the way to a checksum.
PIECE = 4096
#: Rows that a partition sorts on average.
SORTED_ROWS = 250_000
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def scan(df: DataFrame, keys: list[str], at: str, folds: dict[str, tuple[Callable, Column]], back: Callable[[Column, Column], Column] | dict[str, Callable], down: bool = False, block: int = BLOCK) -> DataFrame:
    """df with the running fold of each column over its key's rows in the order of `at` (down: from the last on), its own row included.

    A fold is an aggregate function and the column it takes; `back` joins two results of it. df is read twice.
    """
    order = F.desc if down else F.asc
    cut = df.withColumn("_block", F.floor(F.col(at) / block))
    inside = Window.partitionBy(*keys, "_block").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumns({name: fold(c).over(inside) for name, (fold, c) in folds.items()})
    totals = cut.groupBy(*keys, "_block").agg(*(fold(c).alias(name) for name, (fold, c) in folds.items()))
    across = Window.partitionBy(*keys).orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    numbered = totals.select(*keys, "_block", F.row_number().over(Window.partitionBy(*keys).orderBy(order("_block"))).alias("_turn"), *(fold(F.col(name)).over(across).alias("_" + name) for name, (fold, _) in folds.items()))
    before = numbered.where("_turn > 1")
    join = back if isinstance(back, dict) else dict.fromkeys(folds, back)
    both = own.join(before, [*keys, "_block"], "left")
    return both.withColumns({name: F.when(F.col("_turn").isNull(), F.col(name)).otherwise(join[name](F.col("_" + name), F.col(name))) for name in folds}).drop("_block", "_turn", *("_" + name for name in folds))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row among those of its conversation in its (sorted) partition, from 1 on."""
    from pyspark import TaskContext

    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        first = np.flatnonzero(np.concatenate(([ids[0] != last], ids[1:] != ids[:-1])))
        begin = np.zeros(len(ids), np.int64)
        begin[first] = first
        place = np.arange(len(ids)) - np.maximum.accumulate(begin) + 1
        if not len(first) or first[0]:
            place[: first[0] if len(first) else len(ids)] += count
        last, count = ids[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(place), *(batch.column(c) for c in ("y1", "y2", "chars"))], ["conv_id", "part", "place", "y1", "y2", "chars"])


def ordered(spark: SparkSession, conversations: DataFrame, write: Callable) -> DataFrame:
    """(conv_id, pos, y1, y2, chars) of every turn: its place in its conversation from 1 on, a 128-bit hash of role and text, code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("y1"), F.xxhash64(F.lit(1), role, text).alias("y2"), F.length(text).cast("long").alias("chars"))
    order = ["conv_id", "turn", "y1", "y2"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), conversations.count() // SORTED_ROWS)
    numbered = write(streamed(told.repartitionByRange(n, *order).sortWithinPartitions(*order), _number, "conv_id long, part int, place long, y1 long, y2 long, chars long"), "turns")
    ends = numbered.groupBy("conv_id", "part").agg(F.max("place").alias("own"))
    earlier = ends.select("conv_id", "part", F.sum("own").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier")).where("earlier is not null")
    # only the conversation with which a partition begins goes on in it: one row a partition at most
    return numbered.join(F.broadcast(earlier), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("earlier", F.lit(0))).alias("pos"), "y1", "y2", "chars")


def rebuilt(turns: DataFrame, write: Callable) -> tuple[DataFrame, DataFrame]:
    """(conversations with their depth, their turns) after each has got the first h turns of the first of its hundred in place of its own first h.

    turns is as of ordered(); h is the crc32 of the decimal id modulo 6. Both come as written tables: (conv_id, depth)
    and (conv_id, depth, x1, x2, chars, last), x1 and x2 being hashes of the turn and its place.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % 100).alias("base")
    heads = write(turns.where("conv_id % 100 = 0 and pos <= 5"), "heads")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", h, base)
    given = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("given"))
    lead = F.least("h", F.coalesce("given", F.lit(0)))
    convs = write(sizes.join(given, "base", "left").select("conv_id", "base", "n", "h", lead.alias("lead"), (lead + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    first = convs.where("lead > 0").join(heads.withColumnRenamed("conv_id", "base"), "base").where("pos <= h").withColumn("depth", F.col("pos"))
    own = looked_up(turns, convs, ["conv_id"], F.col("n") > hot(convs.count())).where("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("lead"))
    columns = ["conv_id", "depth", F.xxhash64("depth", "y1").alias("x1"), F.xxhash64("depth", "y2").alias("x2"), "chars", (F.col("depth") == F.col("size")).alias("last")]
    return convs.select("conv_id", F.col("size").alias("depth")), write(first.select(*columns).unionByName(own.select(*columns)), "rebuilt")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the list of ids of each node, from a partition sorted by node and id."""
    for batch in batches:
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("depth", "k1", "k2")]
        ids = batch.column("conv_id").to_pylist()
        new = np.zeros(len(ids), bool)
        new[::PIECE] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        at = np.flatnonzero(new).tolist()
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(at, [*at[1:], len(ids)])]
        yield pa.RecordBatch.from_arrays([*(pa.array(k[at]) for k in keys), pa.array([ids[a] for a in at], pa.int64()), pa.array(texts, pa.string())], ["depth", "k1", "k2", "least", "piece"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The checksum of each node's pieces, from a partition sorted by node and piece."""
    last, digest = None, None
    for batch in batches:
        rows: list[tuple] = []
        for *key, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "piece"))):
            if key != last:
                if last:
                    rows.append((*last, digest.hexdigest()))
                last, digest = key, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield _rows(rows)
    if last:
        yield _rows([(*last, digest.hexdigest())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["depth", "k1", "k2", "ends_sha256"])


def end_sums(prefixes: DataFrame, n: int) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which conversations end; only the last hashing of a node's ids, in pieces, is one task's."""
    node = ["depth", "k1", "k2"]
    ends = prefixes.where("last").select(*node, "conv_id")
    pieces = streamed(ends.repartitionByRange(n, *node, "conv_id").sortWithinPartitions(*node, "conv_id"), _pieces, "depth long, k1 long, k2 long, least long, piece string")
    return streamed(pieces.repartition(n, *node).sortWithinPartitions(*node, "least"), _sums, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """One row (NODES) per node of the trie of the rebuilt conversations (conv_id, turn, role, text).

    Conversations are ordered by turn, null first; rows of one turn by a hash of role and text, so repeated rows are turns of
    their own. A null role or text is empty; rows with a null conv_id belong to no conversation. Ids are rebuilt as
    rebuilt() tells. Other columns are ignored; an empty table gives no rows, not even a root.
    """
    node = ["depth", "k1", "k2"]
    with scratch(spark) as write:
        convs, turns = rebuilt(ordered(spark, conversations, write), write)
        xor = lambda a, b: a.bitwiseXOR(b)
        keyed = scan(turns, ["conv_id"], "depth", {"k1": (F.bit_xor, F.col("x1")), "k2": (F.bit_xor, F.col("x2"))}, xor)
        zero = F.lit(0).cast("long")
        root = convs.select("conv_id", *(zero.alias(c) for c in ("depth", "x1", "x2", "chars")), (F.col("depth") == 0).alias("last"), zero.alias("k1"), zero.alias("k2"))
        prefixes = write(keyed.select("conv_id", F.col("depth").cast("long").alias("depth"), "x1", "x2", "chars", "last", "k1", "k2").unionByName(root), "prefixes")
        often = hot(prefixes.count())

        above = (F.min(xor(F.col("k1"), F.col("x1"))).alias("p1"), F.min(xor(F.col("k2"), F.col("x2"))).alias("p2"))
        nodes = write(prefixes.groupBy(*node).agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), *above), "nodes")
        kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
        heavy = F.max(F.struct("n_convs", (-F.col("node")).alias("less")))
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), conversations.count() // SORTED_ROWS)
        kids = kids.agg(F.count(F.lit(1)).alias("n_children"), (-heavy["less"]).alias("heavy"))
        whole = write(nodes.join(kids, node, "left").join(end_sums(prefixes, n), node, "left").withColumn("n_children", F.coalesce("n_children", zero)), "whole")
        parents = write(whole.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("parent"), F.col("heavy").alias("first"), F.col("n_children").alias("siblings")), "parents")
        below = looked_up(whole.where("depth > 0"), parents, ["depth", "p1", "p2"], F.col("siblings") > often).withColumn("light", F.col("node") != F.col("first"))
        tops = whole.where("depth = 0").withColumns({"parent": F.lit(None).cast("long"), "light": F.lit(False)})
        columns = [*node, "node", "n_convs", "n_children", "chars", "ends_sha256", "parent", "light"]
        named = write(below.select(*columns).unionByName(tops.select(*columns)), "named")

        # every conversation knows the light nodes on its way; a node asks the conversation that it is named by
        way = write(looked_up(prefixes.select("conv_id", *node), named, node, F.col("n_convs") > often), "way")
        turned = F.when(F.col("light") | (F.col("depth") == 0), F.struct("depth", "node"))
        levelled = scan(way, ["conv_id"], "depth", {"top": (F.max, turned), "level": (F.sum, F.col("light").cast("long"))}, {"top": lambda a, b: F.greatest(a, b), "level": lambda a, b: a + b})
        leaf = (F.col("n_children") == 0).cast("long")
        saved = (F.col("n_convs") - 1) * F.col("chars")
        kept = levelled.where("conv_id = node").select("conv_id", "depth", "parent", "n_convs", "n_children", "ends_sha256", F.col("top.node").alias("top_node"), F.col("top.depth").alias("top_depth"), "level", leaf.alias("leaf"), saved.alias("saved"))
        paths = write(kept, "paths")
        out = summed(paths, write)
        return written(spark, out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")), "trie")


def summed(paths: DataFrame, write: Callable) -> DataFrame:
    """paths with n_leaves and saved_tokens, the sums of leaf and saved over subtrees: level by level, the paths with most light edges above them first."""
    done: DataFrame | None = None
    hung: DataFrame | None = None
    plus = lambda a, b: a + b
    for level in range(paths.agg(F.max("level")).first()[0] or 0, -1, -1):
        own = paths.where(F.col("level") == level)
        if hung is not None:
            own = own.join(hung, ["conv_id", "depth"], "left")
            own = own.withColumns({"leaf": F.col("leaf") + F.coalesce("more_leaf", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))}).drop("more_leaf", "more_saved")
            own = write(own, "level")
        part = write(scan(own, ["top_node", "top_depth"], "depth", {"n_leaves": (F.sum, F.col("leaf")), "saved_tokens": (F.sum, F.col("saved"))}, plus, down=True), "sums")
        hung = part.where("depth = top_depth").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.sum("n_leaves").alias("more_leaf"), F.sum("saved_tokens").alias("more_saved"))
        done = part if done is None else done.unionByName(part)
    return done


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark, table(spark, sf_dir, "conversations"))


QUERIES = {"op13_conversation_trie": op13_conversation_trie}
SQL = {
    "op13_conversation_trie": """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda acc, b: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(acc, b)), 4294967295::BIGINT), 4294967295) % 6 AS h FROM t GROUP BY conv_id),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS d, role, text FROM (
  SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h)),
p AS (SELECT conv_id, d, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY d) AS prefix, length(text) AS chars FROM r
  UNION ALL SELECT conv_id, 0, [], 0 FROM c),
m AS MATERIALIZED (SELECT conv_id, d, chars, min(conv_id) OVER (PARTITION BY d, prefix) AS node, d = max(d) OVER (PARTITION BY conv_id) AS last FROM p),
n AS MATERIALIZED (SELECT node, d, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM m GROUP BY node, d),
up AS MATERIALIZED (SELECT n.*, m.node AS parent FROM n LEFT JOIN m ON m.conv_id = n.node AND m.d = n.d - 1),
kids AS MATERIALIZED (SELECT parent AS node, d - 1 AS d, count(*) AS k FROM up WHERE d > 0 GROUP BY ALL),
whole AS MATERIALIZED (SELECT up.*, coalesce(kids.k, 0) AS k FROM up LEFT JOIN kids USING (node, d)),
sums AS (SELECT m.node, m.d, sum(CASE WHEN u.k = 0 THEN 1 ELSE 0 END) AS leaves, sum(u.saved) AS saved FROM whole u JOIN m ON m.conv_id = u.node AND m.d <= u.d GROUP BY m.node, m.d)
SELECT w.node AS conv_id, CAST(w.d AS BIGINT) AS depth, w.parent AS parent_conv_id, w.n_convs, CAST(w.k AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
FROM whole w JOIN sums s USING (node, d)
"""
}
