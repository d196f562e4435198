"""The corpus pipeline: documents that are good, clean, different and unseen by benchmarks, packed into sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm import decontamination, ngram_join, packing, quality, toxicity
from mnemolake.llm.common import forget, fresh_names, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier scores below its threshold.

    Null and empty texts are judged like others, by their statistics; rows that repeat are judged alike; all columns
    pass, whatever their names; an empty table stays empty.
    """
    (name,) = fresh_names(docs.columns, "quality")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.add_quality(spark, docs, model, name).where(F.col(name) >= quality.KEEP).drop(name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model scores at or above its threshold.

    Null and empty texts hold nothing toxic and stay; rows that repeat are judged alike; all columns pass, whatever
    their names; an empty table stays empty.
    """
    (name,) = fresh_names(docs.columns, "toxicity")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.add_toxicity(spark, docs, model, name, None).where(F.col(name) < toxicity.TOXIC).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of near duplicates; of equal rows one.

    Documents without words, or with a null doc_id, are near no other and stay; an empty table stays empty.
    """
    return ngram_join.deduplicate(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of a benchmark item occurs.

    Null and empty texts hold none and stay, as do all documents where there are no items; rows that repeat are judged
    alike; an empty table stays empty.
    """
    return decontamination.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens; one row per piece. A null or empty text is its end id alone."""
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Trained models and packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder, read again and deleted after the next stage."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(spark, stage(spark, docs, sf_dir), name)
        if i:
            forget(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
