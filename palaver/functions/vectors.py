"""Vectors: a deterministic embedding of character pairs, and similarity on columns."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 384
MODEL_ID = "bigram-hash-sha256"


def cosine(a: Column, b: Column) -> Column:
    """Dot product of normalised vectors; 0 if one is empty or lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def is_finite(a: Column) -> Column:
    """Not empty, and without NaN and infinities."""
    return (F.size(a) > 0) & F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def _bin(pair: str) -> int:
    return int.from_bytes(hashlib.sha256(pair.encode("utf-8", "surrogatepass")).digest()[:2], "little") % DIMENSIONS


def embed_text(text: str, is_query: bool, bins: dict[str, int] | None = None) -> np.ndarray:
    """Unit vector: the digest of the text gives a faint fingerprint, every pair of characters adds one to a bin of its digest.

    ``bins`` remembers the bins of pairs from one text to the next.
    """
    text = ("query: " if is_query else "passage: ") + text
    bins = {} if bins is None else bins
    pairs = Counter(map("".join, zip(text, text[1:], strict=False)))
    for pair in pairs.keys() - bins.keys():
        bins[pair] = _bin(pair)
    out = np.bincount([bins[p] for p in pairs], list(pairs.values()), DIMENSIONS).astype(np.float32)
    digest = np.frombuffer(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), np.uint8)
    out[np.arange(len(digest)) * (DIMENSIONS // len(digest))] += digest * np.float32(0.5 / 255)
    return out / np.linalg.norm(out)


def embed(text: Column, is_query: bool = False) -> Column:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        bins: dict[str, int] = {}  # the distinct pairs of a batch
        return pd.Series([None if t is None else embed_text(t, is_query, bins) for t in texts])

    return run(text)
