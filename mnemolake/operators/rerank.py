"""Reranking by a cross-encoder: a pluggable scorer, its request and response forms, and the blend with earlier scores."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S

#: query and texts to (index, score) pairs; None, or an exception, where there is no answer.
Scorer = Callable[[str, list[str]], list[tuple[int, float]] | None]
#: Shares of the new and the old score, the share of the old one where a blend is not finite, and that of results which got no score.
NEW, OLD, FAILED, UNSCORED = 0.6, 0.4, 0.5, 0.8
#: The names that services give the number of results, and where and how they answer.
TOP = {"voyage": "top_k"}
ANSWERS = {"pinecone": (("data", "results"), ("score", "relevance_score")), "voyage": (("data", "results"), ("relevance_score", "score"))}
USUAL = (("results", "data"), ("relevance_score", "score"))


def request(provider: str, model: str, query: str, texts: list[str]) -> dict:
    """The body that a service of this kind expects."""
    body = {"model": model, "query": query, "documents": texts, TOP.get(provider, "top_n"): len(texts)}
    return body | {"documents": [{"text": t} for t in texts], "rank_fields": ["text"]} if provider == "pinecone" else body


def response(provider: str, data: dict) -> list[tuple[int, float]] | None:
    """(index, score) of each item that has both; None where no list of the answer holds any."""

    def number(value) -> float | None:
        try:
            x = float(value)
        except (TypeError, ValueError):
            return None
        return x if math.isfinite(x) else None

    lists, names = ANSWERS.get(provider, USUAL)
    for where in lists:
        items = data.get(where)
        found = []
        for item in items if isinstance(items, list) else []:
            at = number(item.get("index"))
            scores = [s for s in (number(item.get(n)) for n in names) if s is not None]
            if at is not None and scores:
                found.append((int(at), scores[0]))
        if found:
            return found
    return None


def blended(results: DataFrame, scores: DataFrame, score: str = "fused") -> DataFrame:
    """results (position from 0) joined by position to scores (position, cross): `reranked` is the blend, less of the old score where there is none."""
    both = results.join(F.broadcast(scores), "position", "left")
    mixed = S.clamp01(NEW * F.col("cross") + OLD * F.col(score), FAILED * F.col(score))
    return both.withColumn("reranked", F.when(F.col("cross").isNull(), UNSCORED * F.col(score)).otherwise(mixed))


def rerank(results: DataFrame, query: str, scorer: Scorer | None, fallback: Column, score: str = "fused") -> DataFrame:
    """results (position, text, score) with `reranked` by the scorer, or by the fallback where there is none or it fails.

    The few texts of a search's pool (two times its limit, 40 at most) go to the scorer in one request from the driver.
    """
    found = None
    if scorer:
        rows = [(r.position, r.text) for r in results.select("position", "text").orderBy("position").collect()]
        try:
            found = scorer(query, [t or "" for _, t in rows]) if rows else None
        except Exception:  # whatever the service does wrong, the search goes on
            found = None
    if not found:
        return results.withColumn("reranked", fallback)
    scores = results.sparkSession.createDataFrame([(rows[i][0], float(s)) for i, s in dict(found).items() if 0 <= i < len(rows)], "position long, cross double")
    return blended(results, scores, score)
