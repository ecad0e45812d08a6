"""Hashes, SimHash fingerprints and their bands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Offsets and multipliers of the two 32-bit halves.
LOW_BASE, LOW_PRIME = 0x811C9DC5, 0x01000193
HIGH_BASE, HIGH_PRIME = 0x9E3779B9, 0x85EBCA6B
BITS = 64


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the code points of a text, JVM-side. The product is split so that it stays within a long."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    codes = F.filter(codes, lambda c: c != 0)

    def step(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(c)
        return (x * F.lit(LOW_PRIME).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.aggregate(codes, F.lit(LOW_BASE).cast("bigint"), step)


def _fold(codes: np.ndarray, base: int, prime: int) -> np.ndarray:
    h = np.full(codes.shape[0], base, np.uint64)
    for k in range(codes.shape[1]):
        h = ((h ^ codes[:, k]) * np.uint64(prime)) & np.uint64(0xFFFFFFFF)
    return h


def hash64(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of UTF-16 codes: the low half read forward, the high half backward."""
    return (_fold(grams[:, ::-1], HIGH_BASE, HIGH_PRIME) << np.uint64(32)) | _fold(grams, LOW_BASE, LOW_PRIME)


def simhash_of(text: str, size: int = 3) -> int:
    t = text.strip()
    if not t:
        return 0
    codes = np.frombuffer(t.encode("utf-16-le"), np.uint16).astype(np.uint64)
    rows = codes[None, :] if len(codes) <= size else np.lib.stride_tricks.sliding_window_view(codes, size)
    h = hash64(rows)
    ones = ((h[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).sum(axis=0).astype(np.int64)
    set_bits = (2 * ones > len(h)).astype(np.uint64)
    value = int((set_bits << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))
    return value - (1 << 64) if value >= 1 << 63 else value


def simhash(text: Column, size: int = 3) -> Column:
    """64-bit SimHash of character shingles as a signed long; 0 for an empty text; null for null."""
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash_of(t, size) if isinstance(t, str) else None for t in texts], dtype="Int64")

    return F.pandas_udf(run, "bigint")(text)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / BITS


def band_chunk(fp: Column, band: Column, bands: int = 8) -> Column:
    """The band's bits of a fingerprint. Bands must divide 64."""
    if BITS % bands:
        raise ValueError(f"bands must divide {BITS}")
    width = BITS // bands
    shifted = F.call_function("shiftrightunsigned", fp, (band * width).cast("int"))
    return shifted if width == BITS else shifted.bitwiseAND(F.lit((1 << width) - 1))
