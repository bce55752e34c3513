"""Typed settings: environment values with fallbacks, the retrieval policy, session defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


def env(name: str, default, environ: dict | None = None):
    """The variable in the type of ``default``; the default where it is unset or unreadable."""
    raw = (os.environ if environ is None else environ).get(name)
    if raw is None:
        return default
    if isinstance(default, bool):
        return raw.strip().lower() in ("1", "true", "yes", "on")
    try:
        return type(default)(raw)
    except ValueError:
        return default


@dataclass(frozen=True)
class Policy:
    """How candidates are fetched and reranked; one per unit may be given, the default serves all others."""

    candidate_multiplier: int = 6
    min_similarity: float = 0.0
    numeric_weight: float = 0.12
    overlap_weight: float = 0.10
    header_weight: float = 0.08
    expand: bool = True
    max_context_chunks: int | None = None
    fallback_answer: str = "Bu soruya yanıt verecek bir kaynak bulunamadı."


@dataclass(frozen=True)
class Settings:
    embedding_dim: int = field(default_factory=lambda: env("BRINDLE_EMBEDDING_DIM", 2048))
    embedding_batch: int = field(default_factory=lambda: env("BRINDLE_EMBEDDING_BATCH", 128))
    chunk_size: int = field(default_factory=lambda: env("BRINDLE_CHUNK_SIZE", 1000))
    chunk_overlap: int = field(default_factory=lambda: env("BRINDLE_CHUNK_OVERLAP", 200))
    rate_limit: int = field(default_factory=lambda: env("BRINDLE_RATE_LIMIT", 100))
    rate_window_s: int = field(default_factory=lambda: env("BRINDLE_RATE_WINDOW", 3600))
    cache_ttl_s: int = field(default_factory=lambda: env("BRINDLE_CACHE_TTL", 3600))


def policy_for(unit: str | None, policies: dict[str, Policy] | None = None) -> Policy:
    return (policies or {}).get((unit or "").strip().lower(), Policy())


SESSION = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(builder=None) -> SparkSession:
    """A session with the engine's defaults."""
    builder = builder or SparkSession.builder
    for k, v in SESSION.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
