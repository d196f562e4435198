"""Scores as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DAY_MS


def clamp01(v: Column, fallback: float | Column = 0.0) -> Column:
    """v between 0 and 1, the fallback where it is not finite; v is evaluated once."""
    other = fallback if isinstance(fallback, Column) else F.lit(fallback)
    one = F.transform(F.array(v), lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))))
    return F.coalesce(F.element_at(one, 1), other)


def once(v: Column, f: Callable[[Column], Column]) -> Column:
    """f(v), with v standing once in it however often f names it: filters that are pushed below such a column do not multiply it."""
    return F.element_at(F.transform(F.array(v), f), 1)


def query_vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero; null for different lengths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def distance_score(d: Column) -> Column:
    return 1 / (1 + d)


def bm25_sigmoid(raw: Column) -> Column:
    return F.when(raw > 0, 1 / (1 + F.exp(-raw / 5))).otherwise(0.5)


def age_days(ts: Column, now_ms: int) -> Column:
    return F.when(ts > 0, (F.lit(now_ms) - ts) / float(DAY_MS)).otherwise(0.0)


def _where_on(on: Column | bool, score: Column, other: Column) -> Column:
    """score where a stage is on, by a setting that is one for all rows or each row's own."""
    return F.when(on, score).otherwise(other) if isinstance(on, Column) else score


def recency(score: Column, ts: Column, now_ms: int, days: float | Column, weight: float | Column) -> Column:
    on = (days > 0) & (weight != 0) if isinstance(days, Column) else days > 0 and bool(weight)
    return _where_on(on, clamp01(score + F.exp(-age_days(ts, now_ms) / days) * weight, score), score) if isinstance(on, Column) or on else score


def importance(score: Column, value: Column) -> Column:
    return clamp01(score * (0.7 + 0.3 * F.coalesce(value, F.lit(0.7))), score * 0.7)


def asset_weight(score: Column, scope: Column, metadata: Column) -> Column:
    source, named = F.get_json_object(metadata, "$.source"), F.get_json_object(metadata, "$.assetType")
    kind = F.coalesce(F.when(named != "", named), F.when(scope.startswith("asset:brief:"), "memory-brief").otherwise("pinned-memory"))
    factor = F.when(kind == "memory-brief", 0.88).when(kind == "pinned-memory", 1.04).otherwise(1.0)
    return F.when((F.coalesce(source, F.lit("")) == "asset") | scope.startswith("asset:"), clamp01(score * factor, score * 0.75)).otherwise(score)


def length_norm(score: Column, text: Column, anchor: float | Column) -> Column:
    own = anchor if isinstance(anchor, Column) else float(anchor)
    return _where_on(anchor > 0, clamp01(score / (1 + 0.5 * F.log2(F.greatest(F.length(text) / own, F.lit(1.0)))), score * 0.3), score) if isinstance(anchor, Column) or anchor > 0 else score


def time_decay(score: Column, ts: Column, now_ms: int, days: float | Column) -> Column:
    return _where_on(days > 0, clamp01(score * (0.5 + 0.5 * F.exp(-age_days(ts, now_ms) / days)), score * 0.5), score) if isinstance(days, Column) or days > 0 else score


def fused(vec: Column, bm25: Column) -> Column:
    return F.when(vec.isNotNull(), clamp01(vec + F.when(bm25.isNotNull(), 0.15).otherwise(0.0) * vec, 0.1)).otherwise(clamp01(bm25, 0.1))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


K1, B = 1.2, 0.75
