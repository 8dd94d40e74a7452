"""Hash embeddings as vectorised functions: no model, no network, the same on every machine."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OTHER = re.compile(r"[^a-z0-9_]+")
_WRAP = (1 << 64) - 1


def fnv32(s: str) -> int:
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def fnv64(s: str) -> int:
    h = 14695981039346656037
    for b in s.encode():
        h = (h ^ b) * 1099511628211 & _WRAP
    return h


def _unit(v: np.ndarray) -> list[float]:
    n = np.sqrt((v * v).sum())
    return (v / n if n > 0 else v).astype(np.float32).tolist()


def bag_vector(text: str | None, dims: int = 128) -> list[float]:
    """Distinct tokens weigh 1 and their character trigrams 0.35, each in the bucket of its FNV-1a hash."""
    v = np.zeros(dims)
    for t in dict.fromkeys(t for t in _OTHER.sub(" ", (text or "").lower()).split() if len(t) >= 2):
        v[fnv32(t) % dims] += 1.0
        for i in range(len(t) - 2):
            v[fnv32(t[i : i + 3]) % dims] += 0.35
    return _unit(v)


def positional_vector(text: str | None, dims: int = 256) -> list[float]:
    """Signed 64-bit hashes of words (1.5) and of their 3- and 4-grams (0.4), weighing less the later they stand."""
    v = np.zeros(dims)
    for place, t in enumerate(_OTHER.sub(" ", (text or "").lower()).split()):
        weight = 1.0 / (1.0 + 0.05 * place)
        parts = [(t, 1.5)] + [(t[i : i + n], 0.4) for n in (3, 4) for i in range(len(t) - n + 1)]
        for part, w in parts:
            u = fnv64(part)
            v[u % dims] += (-w if u >> 32 & 1 else w) * weight
    return _unit(v)


def embedding(provider=bag_vector, dims: int = 128):
    """A pandas UDF of text to array<float> for any function (text, dims) -> list of floats."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: provider(s, dims))

    return embed
