"""Retrieval parameters and the four named profiles."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class RetrievalConfig:
    mode: str = "hybrid"
    min_score: float = 0.3
    rerank: str = "cosine"
    candidate_pool_size: int = 20
    recency_days: float = 14  # an e-folding time
    recency_weight: float = 0.10
    decay_days: float = 60
    length_anchor: int = 500
    hard_min_score: float = 0.35
    filter_noise: bool = True
    diversity: float = 0.85


#: The shipped configuration, and what each profile changes.
SHIPPED = RetrievalConfig(recency_days=30, decay_days=120, hard_min_score=0.3)
PROFILES = {
    "default": {},
    "writing": {"candidate_pool_size": 28, "recency_days": 90, "recency_weight": 0.06, "decay_days": 365, "length_anchor": 800, "hard_min_score": 0.24},
    "debug": {"candidate_pool_size": 24, "recency_days": 7, "recency_weight": 0.15, "decay_days": 30, "length_anchor": 420, "hard_min_score": 0.34},
    "fact-check": {"candidate_pool_size": 26, "recency_days": 21, "recency_weight": 0.08, "decay_days": 45, "length_anchor": 360, "hard_min_score": 0.38},
}
ALIASES = {"factcheck": "fact-check", "fact_check": "fact-check", "general": "default", "": "default"}
#: A search arm gives at most so many rows, whatever the pool size.
ARM_LIMIT = 20
ARM_MIN_SCORE = {"hybrid": 0.1, "vector": 0.3}


def resolve_profile(name: str | None) -> str:
    found = (name or "").strip().lower()
    found = ALIASES.get(found, found)
    if found not in PROFILES:
        raise ValueError(f"unknown retrieval profile: {name}")
    return found


def config(profile: str | None = None, **overrides) -> RetrievalConfig:
    return replace(SHIPPED, **{**PROFILES[resolve_profile(profile)], **overrides})


def clamp_limit(value: float | None, low: int = 1, high: int = ARM_LIMIT) -> int:
    if value is None or value != value or value in (float("inf"), float("-inf")):
        return low
    return int(min(high, max(low, value // 1)))


def parse_limit(value: str | None, fallback: int | None = None, low: int = 1, high: int = 50) -> int:
    """The whole number that a text begins with, between low and high; the fallback, or an error if there is none, for other texts."""
    found = re.match(r"\s*([+-]?[0-9]+)", value or "")
    if found:
        return min(high, max(low, int(found[1])))
    if fallback is None:
        raise ValueError(f"not a whole number: {value!r}")
    return fallback
