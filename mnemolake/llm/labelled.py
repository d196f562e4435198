"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, keep_only, remainder, streamed

#: Labelled documents that a classifier is fitted on at most; they go to one task.
SAMPLE = 6000
#: Characters of a document in the sample at most.
SAMPLE_CHARS = 100_000


def training_sample(documents: DataFrame, labels: DataFrame, column: str, modulus: int, held_out: int, limit: int = SAMPLE) -> DataFrame:
    """documents with a column y (0 or 1) for at most `limit` labelled ids that are not held out.

    The ids are the first by hash, so every run takes the same ones. Ids or labels that are null are left out;
    an id labelled twice takes its greater label, an id of several documents the one with the least text hash. Texts beyond
    SAMPLE_CHARS characters are left out of the sample (they are scored whole), so its size is bounded.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(column) > 0).cast("int").alias("y"))
    known = known.where(remainder(F.col("doc_id"), modulus) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = documents.join(F.broadcast(taken), "doc_id").where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    one = found.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    several = found.join(F.broadcast(one), "doc_id").where(F.xxhash64("text") == F.col("least")).drop("least", "rows").dropDuplicates(["doc_id"])
    return found.join(F.broadcast(one), "doc_id", "left_anti").unionByName(several)


def fitted(sample: DataFrame, fit: Callable[[list[tuple]], object]) -> object:
    """fit(rows of a bounded sample by doc_id and text, without doc_id, its last column), in one task; the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        docs = list(zip(*(rows[c].to_pylist() for c in rows.column_names[:-1])))
        del held, rows
        model = pickle.dumps(fit(docs))
        del docs
        give_back()
        yield pa.RecordBatch.from_pydict({"model": pa.array([model], pa.binary())})

    found = streamed(sample.repartition(1), run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([])
