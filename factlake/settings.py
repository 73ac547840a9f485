"""Run-time settings, validated once on the driver."""

from __future__ import annotations

from dataclasses import dataclass

CHUNK_TYPES = ("full", "sliding")


@dataclass(frozen=True)
class Settings:
    chunk_type: str = "full"
    top_k: int = 3
    temperature: float = 0.0
    thinking: bool = True
    context_cap: int = 2048
    chunk_size: int = 256
    chunk_overlap: int = 64

    def __post_init__(self) -> None:
        if self.chunk_type not in CHUNK_TYPES:
            raise ValueError(f"chunk_type must be one of {CHUNK_TYPES}")
        if self.top_k < 1:
            raise ValueError("top_k must be at least 1")
        if not 0.0 <= self.temperature <= 1.0:
            raise ValueError("temperature must lie in [0, 1]")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must lie in [0, chunk_size)")
