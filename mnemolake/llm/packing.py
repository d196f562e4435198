"""Packing of token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import runs, streamed, table
from .token_files import with_ends
from .tokens import tokenizer

LENGTH = 1024
END_ID = 0
#: Documents that one group holds on average.
GROUP_DOCS = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """The room left in bins; first_fit finds the leftmost bin with enough room in logarithmic time."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        best, i = self.best, 1
        while i < self.leaves:
            i *= 2
            if best[i] < need:
                i += 1
        room = best[i] = best[i] - need
        leaf = i - self.leaves
        while i > 1:
            room = best[i ^ 1] if best[i ^ 1] > best[i] else best[i]
            i //= 2
            if best[i] == room:
                break
            best[i] = room
        return leaf


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each length; lengths of equal size keep their order."""
    tree, out = Tournament(max(1, len(lengths)), capacity), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = tree.first_fit(lengths[i])
    return out


def cut(ids: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(document, start, length, crc32) of full pieces and the rest of each document's ids, given one after another."""
    n = -(-counts // length)
    doc = np.repeat(np.arange(len(counts)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * length
    size = np.minimum(length, counts[doc] - start)
    at = ((np.cumsum(counts) - counts)[doc] + start) * 4
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return doc, start, size, [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + size * 4).tolist())]


def _pieces(path: str, length: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = tokenizer(path)
        seen, salt = 0, TaskContext.get().partitionId()
        for batch in batches:
            ids, counts = with_ends(*tok.encode(batch.column("text")), END_ID)
            doc, start, size, crc = cut(ids, counts, length)
            grp = np.array([zlib.crc32(f"{d} {salt} {seen + i}".encode()) % groups for i, d in enumerate(batch.column("doc_id").to_pylist(), 1)], np.int64)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(counts[doc]), pa.array(grp[doc])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp"])

    return run


def _packed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "grp"):
            size = np.array(group["length"].to_pylist(), np.int64)
            bins = np.array(first_fit_decreasing(size.tolist(), length), np.int64)
            order = np.argsort(bins, kind="stable")
            ends = np.cumsum(size[order])
            first = np.concatenate(([True], np.diff(bins[order]) != 0))
            before = ends - size[order]
            offset = np.empty(len(size), np.int64)
            offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
            sequence = (group["grp"][0].as_py() << 32) + bins
            yield pa.RecordBatch.from_arrays([*(group[c].combine_chunks() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)], PACKED.replace(" long", "").split(", "))

    return run


def pack(spark: SparkSession, documents: DataFrame, tokenizer_path: str, length: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece (PACKED) of every document's ids in sequences of at most length ids.

    Each document's ids and END_ID are cut into full pieces and a rest; each group's pieces are packed by
    first-fit decreasing. A document goes to a group by its id, its place in its partition and the partition, so groups stay even
    whatever ids repeat. Texts do not move: only pieces' sizes and checksums are shuffled. A null text counts
    as empty and yields its end id alone; a null doc_id stays null. An empty table gives no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    groups = max(1, documents.count() // group_docs)
    pieces = streamed(docs, _pieces(tokenizer_path, length, groups), PIECES)
    n = max(1, min(groups, int(spark.conf.get("spark.sql.shuffle.partitions"))) if groups < 200 else groups // 8)
    return pieces.repartition(n, "grp").sortWithinPartitions("grp", "doc_id", "start", "ids_crc32").mapInArrow(_packed(length), PACKED)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op10_pack": op10_pack}
SQL: dict[str, str] = {}
