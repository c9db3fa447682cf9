"""Vector distance, and the deterministic stand-in for an embedding model."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: The 64-bit FNV-1a offset and prime, the shifts of xorshift64, the weights of meaning, role and kind.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
SHIFTS = (13, 7, 17)
MEANING, ROLE, KIND = 0.92, 0.02, 0.06
_MASK = (1 << 64) - 1


def cosine_distance(vector: Column, q: list[float]) -> Column:
    """1 - cosine to a constant vector, elements as float32 and sums in double; infinite for zero vectors, null for null ones."""
    target = np.asarray(q, np.float32).astype(np.float64)
    norm = float(np.sqrt((target * target).sum()))

    @F.arrow_udf(DoubleType())
    def distance(v: pa.Array) -> pa.Array:
        ok = np.array(v.is_valid())
        lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(v), 0))
        fits = ok & (lengths == len(target))
        out = np.full(len(v), np.nan)
        if fits.any():
            flat = v.filter(pa.array(fits)).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(target))
            denominator = np.sqrt((x * x).sum(1)) * norm
            with np.errstate(divide="ignore", invalid="ignore"):
                out[fits] = np.where(denominator <= 1e-10, np.inf, 1.0 - (x @ target) / denominator)
        return pa.array(out, pa.float64(), mask=~fits | np.isnan(out))

    return distance(vector)


def _from_seed(text: str, dim: int) -> np.ndarray:
    h = FNV_OFFSET
    for b in text.encode():
        h = ((h ^ b) * FNV_PRIME) & _MASK
    out = np.empty(dim, np.float32)
    a, b, c = SHIFTS
    for i in range(dim):
        h ^= (h << a) & _MASK
        h ^= h >> b
        h ^= (h << c) & _MASK
        out[i] = np.float32(np.float32(h / _MASK) * np.float32(2) - np.float32(1))
    return _unit(out)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.float32(np.sqrt((x.astype(np.float64) ** 2).sum()))
    return x / norm if norm > np.finfo(np.float32).eps else x


def mock_embedding(text: str, dim: int, *, role: str = "document", kind: str = "text") -> list[float]:
    """A vector that depends on the trimmed, lower-cased text alone (and a little on role and kind)."""
    key = text.strip().translate(_LOWER)
    parts = (_from_seed(f"semantic:{key}", dim), _from_seed(f"role:{role}", dim), _from_seed(f"modality:{kind}", dim))
    mixed = sum(p * np.float32(w) for p, w in zip(parts, (MEANING, ROLE, KIND), strict=True))
    return _unit(mixed.astype(np.float32)).tolist()


def several(provider, texts: list[str], dim: int) -> list[list[float]]:
    """The vectors of several texts: in one call if the provider has ``many``."""
    return provider.many(texts, dim) if hasattr(provider, "many") else [provider(t, dim) for t in texts]


class Chunked:
    """A provider that takes long texts: their vector is the mean of their chunks' vectors."""

    def __init__(self, provider=None, chunk: int = 1000, overlap: int = 128):
        self.provider, self.chunk, self.overlap = provider or mock_embedding, chunk, overlap

    def parts(self, text: str) -> list[str]:
        if len(text) <= self.chunk:
            return [text]
        return [text[i : i + self.chunk] for i in range(0, max(1, len(text) - self.overlap), max(1, self.chunk - self.overlap))]

    def __call__(self, text: str, dim: int) -> list[float]:
        return self.many([text], dim)[0]

    def many(self, texts: list[str], dim: int) -> list[list[float]]:
        parts = [self.parts(t) for t in texts]
        vectors, out, at = several(self.provider, [p for ps in parts for p in ps], dim), [], 0
        for ps in parts:
            own = vectors[at : at + len(ps)]
            at += len(ps)
            out.append(own[0] if len(ps) == 1 else _unit(np.mean(np.array(own, np.float32), axis=0)).tolist())
        return out


def embed_texts(dim: int, provider=mock_embedding):
    """An Arrow UDF: texts to vectors by ``provider(text, dim)``; equal texts of a batch are embedded once."""
    from pyspark.sql.types import ArrayType, FloatType

    @F.arrow_udf(ArrayType(FloatType()))
    def embed(t: pa.Array) -> pa.Array:
        coded = t.dictionary_encode()
        own = several(provider, coded.dictionary.to_pylist(), dim)
        return pa.array([None if i is None else own[i] for i in coded.indices.to_pylist()], pa.list_(pa.float32()))

    return embed
