"""Conversation turns: pairing, sessions, repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

USER, ASSISTANT = "[用户]", "[助手]"


def pair_turns(turns: DataFrame, key: str, seq: str) -> DataFrame:
    """A user turn and the assistant turn right after it become one text; others stand alone with their mark."""
    w = W.partitionBy(key).orderBy(seq)
    t = turns.withColumn("_next", F.lead("role").over(w)).withColumn("_last", F.lag("role").over(w)).withColumn("_answer", F.lead("text").over(w))
    t = t.where(~((F.col("role") == "assistant") & (F.coalesce("_last", F.lit("")) == "user")))
    both = (F.col("role") == "user") & (F.coalesce("_next", F.lit("")) == "assistant")
    text = F.when(both, F.concat(F.lit(f"{USER} "), "text", F.lit(f"\n\n{ASSISTANT} "), "_answer")).otherwise(F.concat(F.when(F.col("role") == "user", USER).otherwise(ASSISTANT), F.lit(" "), "text"))
    return t.withColumn("pair", text).withColumn("merged", both).drop("_next", "_last", "_answer")


def fill_session(turns: DataFrame, key: str, seq: str, session: str, first: bool) -> DataFrame:
    """The first (or the last) session id seen so far, empty before any."""
    w = W.partitionBy(key).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    value = F.when(F.col(session) != "", F.col(session))
    return turns.withColumn("session", F.coalesce((F.first if first else F.last)(value, ignorenulls=True).over(w), F.lit("")))


def drop_repeats(turns: DataFrame, key: str, seq: str, column: str) -> DataFrame:
    """Rows whose value differs from the one before."""
    w = W.partitionBy(key).orderBy(seq)
    return turns.withColumn("_before", F.lag(column).over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col(column))).drop("_before")
