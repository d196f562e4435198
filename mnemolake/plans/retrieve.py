"""The retrieval chain: arms, fusion, rerank, score stages, cutoff, noise, diversity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.text import is_noise
from ..operators.rerank import Scorer, rerank
from ..operators.search import bm25_topk, vector_topk
from ..schema import NOW_MS
from .config import ARM_LIMIT, ARM_MIN_SCORE, RetrievalConfig, clamp_limit

STAGES = ("recency", "importance", "asset", "length", "decay")


def fuse(vec: DataFrame, bm25: DataFrame, config: RetrievalConfig | None = None) -> DataFrame:
    """Full outer join by id of two arms (at most 20 rows each): vector scores rise by 15 % with a keyword hit."""
    own = [c for c in vec.columns if c not in ("score", "rank", "distance", "raw")]
    v = vec.select(*own, F.col("score").alias("vec_score"), F.col("rank").alias("vec_rank"))
    b = bm25.select(*(F.col(c).alias(f"b_{c}") if c != "id" else F.col(c) for c in own), F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    joined = v.join(b, "id", "full_outer")
    order = F.coalesce(F.col("vec_rank"), F.lit(1000) + F.col("bm25_rank"))
    rest = [F.coalesce(F.col(c), F.col(f"b_{c}")).alias(c) for c in own if c != "id"]
    return joined.select("id", *rest, "vec_score", "vec_rank", "bm25_score", "bm25_rank", S.fused(F.col("vec_score"), F.col("bm25_score")).alias("fused"), order.alias("ord"))


def score_stages(df: DataFrame, start: str, cfg: RetrievalConfig, now_ms: int = NOW_MS) -> DataFrame:
    """One column for each stage; the last is the score."""
    ts = F.col("timestamp_ms")
    steps = {
        "recency": lambda s: S.recency(s, ts, now_ms, cfg.recency_days, cfg.recency_weight),
        "importance": lambda s: S.importance(s, F.col("weight")),
        "asset": lambda s: S.asset_weight(s, F.col("scope"), F.col("metadata")),
        "length": lambda s: S.length_norm(s, F.col("text"), cfg.length_anchor),
        "decay": lambda s: S.time_decay(s, ts, now_ms, cfg.decay_days),
    }
    out, last = df.withColumnRenamed("importance", "weight"), start
    for name in STAGES:
        out, last = out.withColumn(name, S.once(F.col(last), steps[name])), name
    return out.withColumn("score", F.col("decay"))


def stage_order(start: list[str]) -> list[Column]:
    """What successive stable sorts amount to: the last stage first, then those before it, then the first order."""
    return [*(F.desc(F.round(c, 9)) for c in (*reversed(STAGES), *start)), F.asc("ord")]


def diversify(df: DataFrame, threshold: float = 0.85, order: list[Column] | None = None) -> DataFrame:
    """Adds position: rows in order that are not too similar to one before come first, the others after them.

    For the few rows of a search: they are gathered once and folded, so no pairs are joined.
    """
    ranked = df.withColumn("_r", F.row_number().over(W.orderBy(*(order or [F.asc("ord")]))))
    items = ranked.agg(F.array_sort(F.collect_list(F.struct(F.col("_r").alias("r"), F.col("vector").alias("v")))).alias("items"))
    empty = F.array().cast("array<struct<r:int,v:array<float>>>")
    near = lambda sel, x: F.exists(sel, lambda y: (F.size(x["v"]) > 0) & (F.size(y["v"]) > 0) & (S.cosine(x["v"], y["v"]) > threshold))
    chosen = F.aggregate("items", empty, lambda sel, x: F.when(near(sel, x), sel).otherwise(F.concat(sel, F.array(x))))
    kept = items.select(F.transform(chosen, lambda x: x["r"]).alias("kept"))
    marked = ranked.join(F.broadcast(kept)).withColumn("_d", (~F.array_contains("kept", F.col("_r"))).cast("int"))
    return marked.withColumn("position", F.row_number().over(W.orderBy("_d", "_r")).cast("long")).drop("_r", "_d", "kept")


def retrieve(df: DataFrame, vector: list[float] | None, query: list[str], cfg: RetrievalConfig, limit: int = 5, scopes: list[str] | None = None, category: str | None = None, now_ms: int = NOW_MS, query_text: str | None = None, scorer: Scorer | None = None, keywords: Callable[..., DataFrame] = bm25_topk) -> DataFrame:
    """At most `limit` rows in order of position, with the score of each stage and of each arm.

    With a scorer and the cross-encoder's setting, its scores of the pool's texts are blended in; without an answer of it
    the cosines are. `keywords` gives the keyword results, as bm25_topk does. A search without a vector goes by keywords alone.
    """
    limit = clamp_limit(limit)
    of = lambda arm: arm if category is None else arm.where(F.col("category") == category)
    near = lambda k, least: vector_topk(df, vector, k, least, scopes) if vector else vector_topk(df.limit(0), [0.0], k, least)
    if cfg.mode == "vector":
        found = of(near(limit, ARM_MIN_SCORE["vector"]))
        found = found.withColumn("vec_score", F.col("score")).withColumn("vec_rank", F.col("rank")).withColumn("bm25_score", F.lit(None).cast("double")).withColumn("bm25_rank", F.lit(None).cast("long")).withColumn("fused", F.col("score")).withColumn("ord", F.col("rank")).drop("score", "rank", "distance")
        start, before = "fused", ["fused"]
    else:
        pool = min(ARM_LIMIT, max(cfg.candidate_pool_size, 2 * limit))
        fusedrows = fuse(of(near(pool, ARM_MIN_SCORE["hybrid"])), of(keywords(df, query, pool, scopes))).where(F.col("fused") >= cfg.min_score)
        found, start, before = fusedrows, "fused", ["fused"]
        if cfg.rerank != "none":
            found = found.orderBy(F.desc(F.round("fused", 9)), "ord").limit(2 * limit)
            mixed = S.clamp01(0.7 * F.col("fused") + 0.3 * S.cosine(F.col("vector"), S.query_vector(vector)), F.col("fused")) if vector else F.col("fused")
            if cfg.rerank == "cross-encoder" and scorer:
                place = W.orderBy(F.desc(F.round("fused", 9)), "ord")
                found = rerank(found.withColumn("position", F.row_number().over(place).cast("long") - 1), query_text or " ".join(query), scorer, mixed).drop("position", "cross")
            else:
                found = found.withColumn("reranked", mixed)
            start, before = "reranked", ["reranked", "fused"]
    found = score_stages(found, start, cfg, now_ms).where(F.col("score") >= cfg.hard_min_score)
    if cfg.filter_noise:
        found = found.where(~is_noise(F.col("text")))
    return diversify(found, cfg.diversity, stage_order(before)).where(F.col("position") <= limit)


def reduce_paths(vec: str = "vec_rank", bm25: str = "bm25_rank", reranked: str | None = None) -> Column:
    """How a row was found: vector, bm25 and reranked joined by +, or direct."""
    parts = [F.when(F.col(vec).isNotNull(), "vector"), F.when(F.col(bm25).isNotNull(), "bm25")]
    if reranked:
        parts.append(F.when(F.col(reranked).isNotNull(), "reranked"))
    joined = F.concat_ws("+", *parts)
    return F.when(joined != "", joined).otherwise("direct")
