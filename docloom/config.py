"""Engine defaults. They are part of the semantics, so every operator takes them as keyword arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    min_chunk_size: int = 150
    dense_top_k: int = 20
    entity_top_k: int = 10
    rerank_top_k: int = 5
    rrf_k: int = 60
    embedding_dim: int = 384
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    history_limit: int = 500
    web_fallback: bool = False
    web_threshold: float = 0.75
    web_max_results: int = 5


DEFAULTS = EngineConfig()
