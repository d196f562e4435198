"""Token ids of documents in binary shards, compressed by Re-Pair grammars that can be read at random.

A shard holds the ids of consecutive documents. Frequent pairs of neighbouring symbols within a document are
replaced by new symbols, again and again, until no pair occurs often enough; the rules and the length that
each new symbol expands to are stored, so that any document, and any span of it, is decoded alone.

Layout of a shard's bytes, little-endian: b"RPR1", then five uint32 (documents, rules, symbols, first new
symbol, bytes per symbol), doc ids (int64; null as the least int64), tokens per document (uint32), first symbol of each document and the
end (uint32), rules as pairs (uint32), expansion lengths of the rules (uint32), symbols (uint16 or uint32).
Shards are rows of a Parquet table (part, local_start, n_tokens, shard), so any store that Spark writes to
holds them and a lost executor's shards are written again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir
from .tokens import tokenizer

MAGIC = b"RPR1"
NULL_ID = -(1 << 63)
END_ID = 1
SHARD_TOKENS = 1_000_000
#: A pair is replaced while it occurs at least so often in its shard; symbols stay below 2^16.
MIN_COUNT = 24
#: Documents that a partition sorts on average.
SORTED_DOCS = 100_000
RULES_A_ROUND = 4096
SYMBOLS = 1 << 16
SHARDS = "part int, local_start long, n_tokens long, shard binary"


def build_grammar(ids: np.ndarray, ends: np.ndarray, first_new: int, min_count: int = MIN_COUNT, symbols: int = SYMBOLS):
    """(symbols, positions of documents' last symbols, rules) of ids; ends marks the last id of each document.

    A round counts all pairs, takes the most frequent ones and replaces their occurrences; where two overlap,
    the more frequent pair wins, and the earlier occurrence among equals.
    """
    seq, last, rules = ids.astype(np.uint32), ends.copy(), []
    room = symbols - first_new
    slots = 17
    while room > 0 and len(seq) > 1:
        keys = (seq[:-1] << np.uint32(16)) | seq[1:]
        inner = np.sort(keys[~last[:-1]])
        if not len(inner):
            break
        cut = np.flatnonzero(np.concatenate(([True], inner[1:] != inner[:-1])))
        count = np.diff(np.append(cut, len(inner)))
        often = np.flatnonzero(count >= min_count)
        if not len(often):
            break
        top = often[np.argsort(-count[often], kind="stable")][: min(room, RULES_A_ROUND)]
        pairs = inner[cut[top]]
        where = (pairs * np.uint32(2654435761)) >> np.uint32(32 - slots)
        _, kept = np.unique(where, return_index=True)  # of pairs that meet in a slot, the most frequent
        kept.sort()
        pairs, where = pairs[kept], where[kept]
        table = np.full(1 << slots, len(pairs), np.int32)
        table[where] = np.arange(len(pairs), dtype=np.int32)
        rank = table[(keys * np.uint32(2654435761)) >> np.uint32(32 - slots)]
        rank[(np.append(pairs, 0)[rank] != keys) | last[:-1]] = len(pairs)
        take = rank < len(pairs)
        take[1:] &= rank[1:] < rank[:-1]
        take[:-1] &= rank[:-1] <= rank[1:]
        at = np.flatnonzero(take)
        if len(at) < min_count:
            break
        used, new = np.unique(rank[at], return_inverse=True)
        rules.append(np.stack((pairs[used] >> np.uint32(16), pairs[used] & np.uint32(0xFFFF)), 1))
        seq[at] = first_new + new.astype(np.uint32)
        last[at] = last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        shrunk = 1 - len(at) / len(seq)
        seq, last = seq[stay], last[stay]
        first_new, room = first_new + len(used), room - len(used)
        if shrunk > 0.99:  # what is left gains less than its rules cost
            break
    return seq, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, first_new: int) -> np.ndarray:
    out = np.ones(len(rules), np.uint32)
    known = [1] * len(rules)
    for i, (a, b) in enumerate(rules.tolist()):
        known[i] = (known[a - first_new] if a >= first_new else 1) + (known[b - first_new] if b >= first_new else 1)
    if known:
        out[:] = known
    return out


def pack_shard(doc_ids: list, counts: list[int], ids: np.ndarray, min_count: int = MIN_COUNT) -> bytes:
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(counts) - 1] = True
    first_new = int(ids.max()) + 1 if len(ids) else 0
    if first_new <= SYMBOLS:
        seq, last, rules = build_grammar(ids, ends, first_new, min_count)
    else:  # such ids leave no room for new symbols
        seq, last, rules = ids, ends, np.zeros((0, 2), np.uint32)
    wide = 2 if first_new + len(rules) <= SYMBOLS else 4
    offsets = np.append(0, np.flatnonzero(last) + 1)
    head = np.array([len(doc_ids), len(rules), len(seq), first_new, wide], "<u4")
    parts = (head, np.array([NULL_ID if d is None else d for d in doc_ids], "<i8"), np.array(counts, "<u4"), offsets.astype("<u4"), rules.astype("<u4"), expansion_lengths(rules, first_new).astype("<u4"), seq.astype(f"<u{wide}"))
    return MAGIC + b"".join(x.tobytes() for x in parts)


class Shard:
    """Reads a shard's documents, whole or in spans."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        docs, rules, symbols, self.first_new, wide = np.frombuffer(data, "<u4", 5, 4).tolist()
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.counts, self.offsets = take("<i8", docs), take("<u4", docs), take("<u4", docs + 1)
        self.rules, self.lengths = take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules)
        self.symbols = take(f"<u{wide}", symbols)
        self._grown: tuple[np.ndarray, np.ndarray] | None = None

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of a row of symbols: all rules are expanded once, after which it is one gather."""
        if self._grown is None:
            n, flat = self.first_new, []
            for a, b in self.rules.tolist():
                flat.append((flat[a - n] if a >= n else (a,)) + (flat[b - n] if b >= n else (b,)))
            start = np.append(0, np.cumsum(self.lengths, dtype=np.int64)).astype(np.int64)
            self._grown = start, np.array([x for f in flat for x in f], "<u4")
        start, grown = self._grown
        table = np.concatenate((np.arange(self.first_new, dtype="<u4"), grown))
        s = symbols.astype(np.int64)
        new = s >= self.first_new
        rule = np.where(new, s - self.first_new, 0)
        length = np.where(new, self.lengths[rule] if len(self.lengths) else 1, 1).astype(np.int64)
        begin = np.where(new, self.first_new + start[rule], s)
        ends = np.cumsum(length)
        return table[np.repeat(begin - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def length_of(self, symbols: np.ndarray) -> np.ndarray:
        new = symbols >= self.first_new
        out = np.ones(len(symbols), np.int64)
        out[new] = self.lengths[symbols[new].astype(np.int64) - self.first_new]
        return out

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the i-th document; only the symbols that cover them are expanded."""
        symbols = self.symbols[self.offsets[i] : self.offsets[i + 1]]
        stop = int(self.counts[i]) if stop is None else min(stop, int(self.counts[i]))
        ends = np.cumsum(self.length_of(symbols))
        a = int(np.searchsorted(ends, start, "right"))
        b = int(np.searchsorted(ends, stop, "left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - skipped : max(stop, start) - skipped]

    def all(self) -> np.ndarray:
        return self.expand(self.symbols)


def with_ends(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and counts of documents with an end id after each of them."""
    counts = counts + 1
    last = np.cumsum(counts) - 1
    out = np.full(int(last[-1]) + 1 if len(last) else 0, end, "<u4")
    own = np.ones(len(out), bool)
    own[last] = False
    out[own] = ids
    return out, counts


def _encode(path: str, shard_tokens: int, min_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        tok = tokenizer(path)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal done, size
            doc_ids, counts, ids = (sum((h[0] for h in held), []), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            shard = pack_shard(doc_ids, counts.tolist(), ids, min_count)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([done]), pa.array([size]), pa.array([shard], pa.binary())], ["part", "local_start", "n_tokens", "shard"])
            done, size = done + size, 0
            held.clear()
            return out

        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                docs = batch.column("doc_id").slice(i, 2048).to_pylist()
                ids, counts = with_ends(*tok.encode(batch.column("text").slice(i, 2048)), END_ID)
                ends, at, sent = np.cumsum(counts), 0, 0
                while at < len(docs):  # a shard ends with the document that fills it
                    to = min(len(docs), int(np.searchsorted(ends, sent + shard_tokens - size)) + 1)
                    held.append((docs[at:to], counts[at:to], ids[sent : ends[to - 1]]))
                    size += int(ends[to - 1]) - sent
                    at, sent = to, int(ends[to - 1])
                    if size >= shard_tokens:
                        yield flush()
        if held:
            yield flush()

    return run


def write_tokens(spark: SparkSession, documents: DataFrame, path: str, tokenizer_path: str, partitions: int | None = None, shard_tokens: int = SHARD_TOKENS, min_count: int = MIN_COUNT) -> None:
    """Writes the ids of every whole text in ascending doc_id order (null ids first, equal ids by text) as a table of shards.

    A null text counts as empty; every document ends with END_ID. Columns besides doc_id and text are ignored.
    The texts are range-partitioned by doc_id once, and each task streams its own into shards of about shard_tokens.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), documents.count() // SORTED_DOCS)
    docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(_encode(tokenizer_path, shard_tokens, min_count), SHARDS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards at path: doc_id, start, n_tokens, ids (array of int)."""
    return _decoded(spark, path, whole=True)


def _decoded(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, data in zip(batch.column("part").to_pylist(), batch.column("local_start").to_pylist(), batch.column("shard")):
                shard = Shard(data.as_buffer().to_pybytes())
                ids, counts = shard.all(), shard.counts.astype(np.int64)
                ends = np.cumsum(counts)
                cols = [pa.array([part] * len(counts), pa.int32()), pa.array(shard.doc_ids.astype(np.int64), mask=shard.doc_ids == NULL_ID), pa.array(start + ends - counts), pa.array(counts)]
                if whole:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))))
                else:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    cols.append(pa.array([zlib.crc32(raw[(e - c) * 4 : e * 4]) for e, c in zip(ends.tolist(), counts.tolist())], pa.int64()))
                yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "local", "n_tokens", "ids" if whole else "ids_crc32"])

    shards = spark.read.schema(SHARDS).parquet(path)
    # One sum for each writing task comes to the driver, never one for each document or shard.
    sums = sorted(tuple(r) for r in shards.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, total = [], 0
    for part, n in sums:
        before.append((part, total))
        total += n
    base = spark.createDataFrame(before, "part int, base long")
    rest = "ids array<int>" if whole else "ids_crc32 long"
    docs = shards.select("part", "local_start", "shard").mapInArrow(run, f"part int, doc_id long, local long, n_tokens long, {rest}")
    return docs.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", rest.split()[0])


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from .common import table

    path = f"{shared_dir(spark)}/mnemolake/tokens-{uuid.uuid4().hex}"
    write_tokens(spark, table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return _decoded(spark, path, whole=False)


QUERIES = {"op3_token_files": op3_token_files}
SQL: dict[str, str] = {}
