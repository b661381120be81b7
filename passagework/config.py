"""Limits and names that are part of the engine's results."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class EngineConfig:
    # Results depend on them.
    chunk_target_tokens: int = 200
    top_k_all: int = 8
    top_k_filtered: int = 5
    max_chunks_per_document: int = 3
    candidate_k: int = 24
    min_similarity: float = 0.62
    dimension: int = 384
    max_sequence_length: int = 512
    query_prefix: str = "Represent this sentence for searching relevant passages: "
    embedding_model: str = "BAAI/bge-small-en-v1.5"
    generator_model: str = "openai/gpt-oss-120b"
    generator_temperature: float = 0.0
    generator_max_tokens: int = 1024
    min_term_overlap: float = 0.5

    @classmethod
    def from_env(cls, **changes: object) -> EngineConfig:
        """Defaults, then the environment's generator model unless it is blank, then ``changes``."""
        model = os.environ.get("PASSAGEWORK_GENERATOR_MODEL", "").strip()
        return replace(cls(**({"generator_model": model} if model else {})), **changes)
