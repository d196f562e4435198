"""N-gram Jaccard join: near-duplicate documents by word shingles, with Bayesian pruning of candidate pairs.

1. Documents with equal shingle sets form a class; everything after works on one representative of each class.
2. Classes that share a MinHash band share a bucket. Of buckets with the same members the first is kept; one beyond
   BLOCK members is cut into parts, and every two parts are compared by one task.
3. Within a bucket, a pair counts in the first band that it shares. Pairs compare MinHash values a few at a time and
   are dropped once the posterior probability of reaching the threshold is below the tolerance.
4. The whole shingle sets of the members that still have a partner are fetched, and the pairs verified exactly; a
   task returns link counts and a spanning forest, never pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, fresh_names, hot, keep_only, looked_up, runs, scratch, small, streamed, table, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 24, 4
HASHES = BANDS * BAND_ROWS
#: MinHash values that one step of the pruning compares.
STEP = 16
TOLERANCE = 1e-6
BLOCK = 1024
_WORD = re.compile(r"\w+").findall
_RNG = np.random.default_rng(20240501)
_MULTIPLY = _RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_POSITION = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_words = _Words()


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the set of n-word shingles of the lower-case text; a shorter text is one shingle, one without words none."""
    words = _WORD((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    m = min(n, len(h))
    out = np.full(len(h) - m + 1, m, np.uint64)
    for i in range(m):
        out += h[i : len(h) - m + 1 + i] * _POSITION[i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def minhash(found: np.ndarray) -> np.ndarray:
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(out, (x[i : i + 4096, None] * _MULTIPLY + _ADD).min(0), out=out)
    return out


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each step, the fewest equal values with which a pair stays.

    With m of n values equal and a uniform prior, the similarity is Beta(m + 1, n - m + 1); it reaches the
    threshold t with the probability that at most m of n + 1 trials of probability t succeed.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while m < n:
            below += math.comb(n + 1, m + 1) * threshold ** (m + 1) * (1 - threshold) ** (n - m)
            m += 1
            if below >= tolerance:
                break
        out.append(m)
    return tuple(out)


def candidates(sigs: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, band: int | None, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions (of left, of right) that may reach the threshold, some rows of left at a time; i != j.

    Where left and right are the same positions, each pair comes once. A pair whose first common band is not `band`
    is left out (all count if it is None).
    """
    least = least_matches(threshold, tolerance)
    same = len(left) == len(right) and bool((left == right).all())
    wide = np.ascontiguousarray(sigs).view(np.uint64).reshape(len(sigs), BANDS, -1)
    for k in range(0, len(left), 64):
        rows = left[k : k + 64]
        a, b = size[rows][:, None], size[right][None, :]
        stay = np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9
        if same:
            stay &= np.arange(len(right))[None, :] > np.arange(k, k + len(rows))[:, None]
        p, q = np.nonzero(stay)
        p, q = rows[p], right[q]
        for e in range(0 if band is None else band + 1):
            equal = (wide[p, e] == wide[q, e]).all(1)
            alive = equal if e == band else ~equal
            p, q = p[alive], q[alive]
        equal = np.zeros(len(p), np.int32)
        for step, m in enumerate(least):  # incremental comparison
            if not len(p):
                break
            part = slice(step * STEP, (step + 1) * STEP)
            equal += (sigs[p, part] == sigs[q, part]).sum(1, dtype=np.int32)
            alive = equal >= m
            p, q, equal = p[alive], q[alive], equal[alive]
        if len(p):
            yield p, q


def similar_pairs(sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, band: int | None = None, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The candidates whose sets have a Jaccard similarity of threshold or more."""
    size = np.array([len(s) for s in sets], np.int64)
    universe, flat = np.unique(np.concatenate([sets[j] for j in right]), return_inverse=True) if len(right) else (np.zeros(0), np.zeros(0, int))
    start = np.zeros(len(sets) + 1, np.int64)
    start[right] = np.cumsum(size[right]) - size[right]
    mark = np.zeros(len(universe) + 1, np.uint8)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for p, q in candidates(sigs, size, left, right, band, threshold, tolerance):
        for r in np.unique(p):
            mine = sets[r]
            at = np.searchsorted(universe, mine)
            at = at[universe[np.minimum(at, len(universe) - 1)] == mine]
            mark[at] = 1
            others = q[p == r]
            if len(others) * 4 < len(right):
                both = np.array([int(mark[flat[start[j] : start[j] + size[j]]].sum()) for j in others])
            else:
                both = np.zeros(len(sets), np.int64)
                both[right] = np.add.reduceat(mark[flat], start[right], dtype=np.int64)
                both = both[others]
            mark[at] = 0
            good = others[both >= threshold * (len(mine) + size[others] - both) - 1e-9]
            if len(good):
                found.append((np.full(len(good), r), good))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def roots(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """The least position reached from each of n positions by the links a-b."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [top(i) for i in range(n)]


def _identity(found: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8").tolist())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_only(_words.clear)
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            cols: list[list] = [[], [], [], []]
            for text in part.column("text").to_pylist():
                found = shingles(text)
                for col, v in zip(cols, (*_identity(found), len(found), minhash(found).tobytes() if len(found) else None)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["doc_id", "t", "h1", "h2", "n", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_only(_words.clear)
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            found = [shingles(t) for t in batch.column("text").slice(i, 512).to_pylist()]
            keys = [_identity(f) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], ["h1", "h2", "shingles"])


#: What names a task's share of a bucket: its key, and which two of its parts face each other.
PLACE = ("key", "i", "j")


def _faced(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Sketches, set sizes, positions of either side (the same where a part is compared with itself) and the band."""
    sigs = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint32).reshape(-1, HASHES)
    size = group["n"].to_numpy()
    if group["i"][0].as_py() == group["j"][0].as_py():
        left = right = np.arange(len(size))
    else:
        own = group["own"].to_numpy()
        left, right = np.flatnonzero(own == group["i"][0].as_py()), np.flatnonzero(own == group["j"][0].as_py())
    return sigs, size, left, right, group["band"][0].as_py()


def _prune(threshold: float, tolerance: float):
    """The members that keep a candidate partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, *PLACE):
            sigs, size, left, right, band = _faced(group)
            alive = np.zeros(len(size), bool)
            for p, q in candidates(sigs, size, left, right, band, threshold, tolerance):
                alive[p] = alive[q] = True
            if alive.any():
                yield from group.select(["node", "own", "band", *PLACE]).filter(pa.array(alive)).combine_chunks().to_batches()

    return run


def _verify(threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, *PLACE):
            sigs, _, left, right, band = _faced(group)
            node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()]
            a, b = similar_pairs(sigs, sets, left, right, band, threshold, tolerance)
            if len(a):
                yield links_of(node, copies, a, b)

    return run


def links_of(node: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """node, links (weighted by copies) and root (least node reached) of the nodes that pairs of positions (a, b) link."""
    order = np.argsort(node, kind="stable")
    place = np.empty(len(node), np.int64)
    place[order] = np.arange(len(node))
    root = node[order][np.array(roots(len(node), place[a], place[b]))[place]]
    links = (np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))).astype(np.int64)
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(root[some])], ["node", "links", "root"])


def part_pairs(parts: Column, own: Column) -> Column:
    """The pairs (i, j) of a bucket's parts in which a member of part `own` takes part, itself with itself included."""
    others = F.filter(F.sequence(F.lit(0), parts - 1), lambda k: k != own)
    pair = lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"))
    return F.concat(F.array(pair(own)), F.transform(others, pair))


def group_facts(spark: SparkSession, classes: DataFrame, checked: DataFrame, write: Callable) -> DataFrame:
    """h1, h2, copies, class_id, n_links, group_id, first (whether the class stands for its group), from classes and links."""
    sums = checked.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(spark, checked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    ids = write(groups.join(classes.select("node", "class_id"), "node"), "ids")
    least = write(ids.groupBy("root").agg(F.min(F.struct("class_id", "node")).alias("least"), F.count(F.lit(1)).alias("many")).select("root", F.col("least.class_id").alias("group_id"), F.col("least.node").alias("head"), "many"), "least")
    named = looked_up(ids.select("node", "root"), least, ["root"], F.col("many") > hot(ids.count())).select("node", "group_id", "head")
    told = classes.select("h1", "h2", "node", "class_id", "copies").join(sums, "node", "left").join(named, "node", "left")
    return told.select("h1", "h2", "copies", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"), (F.coalesce("head", "node") == F.col("node")).alias("first"))


def _grouped(spark: SparkSession, documents: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """doc_id, t (hash of the text), n, class_id, n_links, group_id, first of every row; a written table."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(spark) as write:
        signed = write(streamed(docs.select("doc_id", "text", F.xxhash64("text").alias("t")), _signatures, "doc_id long, t long, h1 long, h2 long, n long, sig binary"), "signatures")
        usable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
        # 1. classes of equal sets, counted before they are shuffled
        classes = signed.where(usable).groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("sig").alias("sig"))
        classes = write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        # 2. buckets of two or more, once for each set of members
        keys = classes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring(F.col("sig"), i * 4 * BAND_ROWS + 1, F.lit(4 * BAND_ROWS)))).alias("band", "chunk")).select("node", F.xxhash64("band", "chunk").alias("key"), "band")
        met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("band").alias("band"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("m > 1")
        kept = write(met.groupBy("m", "x", "y").agg(F.min(F.struct("band", "key")).alias("b")).select("b.key", "m"), "buckets")
        total = kept.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
        inside = keys.join(F.broadcast(kept), "key") if kept.limit(1_000_001).count() <= 1_000_000 else looked_up(keys, kept, ["key"], F.col("m") > hot(total))
        parts = F.ceil(F.col("m") / block).cast("int")
        own = inside.select("node", "key", "band", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("own"))
        placed = own.select("node", "own", "band", "key", F.explode(part_pairs(F.col("parts"), F.col("own"))).alias("p")).select("node", "own", "band", "key", "p.i", "p.j")
        # 3. pruning by sketches, 4. verification by whole sets
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = lambda df: df.repartition(n, *PLACE).sortWithinPartitions(*PLACE)
        alive = write(streamed(ordered(placed.join(classes.select("node", "n", "sig"), "node")), _prune(threshold, tolerance), "node long, own int, band int, key long, i int, j int"), "alive")
        wanted = classes.join(alive.select("node").distinct(), "node", "left_semi").select("h1", "h2", "node", "class_id", "copies", "n", "sig")
        texts = streamed(docs.join(small(wanted.select(F.col("class_id").alias("doc_id")).distinct()), "doc_id", "left_semi"), _sets, "h1 long, h2 long, shingles binary")
        whole = wanted.join(texts.groupBy("h1", "h2").agg(F.first("shingles").alias("shingles")), ["h1", "h2"]).select("node", "copies", "n", "sig", "shingles")
        checked = write(streamed(ordered(alive.join(whole, "node")), _verify(threshold, tolerance), "node long, links long, root long"), "links")
        facts = write(group_facts(spark, classes, checked, write), "facts")
        # what a class is told goes to its rows; those of large classes stay where they are
        told = looked_up(signed.where(usable).select("doc_id", "t", "n", "h1", "h2"), facts, ["h1", "h2"], F.col("copies") > hot(signed.count()))
        alone = signed.where(~usable).select("doc_id", "t", "n", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("group_id"), F.lit(True).alias("first"))
        return written(spark, told.select(*alone.columns).unionByName(alone), "groups")


def near_duplicates(spark: SparkSession, documents: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, n_links, group_id, kept.

    class_id is the least doc_id with the same shingle set, n_links the number of other documents with a
    similarity of threshold or more, copies included, group_id the least doc_id reached by links and kept
    whether that is the document itself. Documents without words, or with a null doc_id, link with nothing: both ids are their own.
    Rows that repeat count each. Columns besides doc_id and text are ignored; an empty table gives no rows.
    """
    out = _grouped(spark, documents, threshold, tolerance, block)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "n_links", "group_id", F.coalesce(F.col("group_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(spark: SparkSession, documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents without near duplicates: of each group one row stays, with the least doc_id and of those the first by hash of the text.

    Rows are told apart by doc_id and text, so a group that shares an id with another loses none of the other's rows;
    of equal rows one stays. Rows with a null doc_id stay as they are. All columns pass, whatever their names.
    """
    found = _grouped(spark, documents, threshold, TOLERANCE, BLOCK).where("doc_id is not null")
    stays = F.col("first") & (F.col("doc_id") == F.col("class_id"))
    several = small(found.where(stays).groupBy("doc_id", "group_id").agg(F.min("t").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    spare = found.where(stays & (F.col("n") > 0)).join(several, ["doc_id", "group_id"]).where("t <> least").select("doc_id", "t")
    gone = found.where(~stays).select("doc_id", "t").unionByName(spare).distinct()
    ident, key = fresh_names(documents.columns, "id", "text")
    docs = documents.withColumn(ident, F.col("doc_id").cast("long")).withColumn(key, F.xxhash64(F.col("text").cast("string")))
    stay = docs.join(small(gone.select(F.col("doc_id").alias(ident), F.col("t").alias(key))), [ident, key], "left_anti")
    twice = found.where(stays).groupBy("doc_id", "t").count().where("count > 1").select(F.col("doc_id").alias(ident), F.col("t").alias(key))
    if not twice.isEmpty():
        twice = small(twice)  # ids of repeated rows only
        once = stay.join(twice, [ident, key], "left_semi").dropDuplicates([ident, key])
        stay = stay.join(twice, [ident, key], "left_anti").unionByName(once)
    return stay.select(*documents.columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op2_ngram_join": op2_ngram_join}
SQL: dict[str, str] = {}
