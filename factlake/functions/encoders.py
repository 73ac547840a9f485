"""A small deterministic encoder, for runs without an embedding model."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=100_000)
def _digit(word: str, place: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[place], 16)


def hashing_encoder(place: int = 0):
    """Encoder to 16 numbers: words counted by one hex digit of their md5,
    scaled to unit length. A text without words gives zeros."""

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            digits = [_digit(w, place) for w in text.split()]
            counts = np.bincount(digits, minlength=16).astype(float) if digits else np.zeros(16)
            length = np.sqrt((counts * counts).sum())
            out.append((counts / length if length else counts).astype(np.float32))
        return out

    return encode
