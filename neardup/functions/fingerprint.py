"""Similarity fingerprints.

* ``simhash_words``: text fingerprint (Charikar 2002; Manku et al. 2007). Every
  distinct whitespace token votes with the bits of its SHA-256; a bit is set when
  more than half of the tokens set it. It runs as an Arrow-batched pandas UDF in a
  narrow projection (no shuffle): measured 8x faster at sf0.1 than the all-built-in
  form (explode + 128 vote sums), whose wide hash aggregate falls out of codegen.
* ``vector_fingerprint``: 64-bit above-median code of an embedding (built-ins only).
* ``phash_words``: 256-bit DCT hash of decoded pixels (Arrow/pandas, numpy).
* ``gray_levels`` and ``dct_hash``: DCT hash of small gray pictures held as arrays (built-ins only, whole numbers).
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from neardup.session import ship_by_value

# UDF bodies travel with the task; executors need no installed copy of the package.
ship_by_value(__name__)

# Tokens: split on ASCII blanks only, case kept (same rule in Java, RE2 and Python).
TOKEN_SPLIT = r"[ \t\n\r]+"
_SPLIT_RE = re.compile(TOKEN_SPLIT)


# Tokens whose votes are counted at once, and digests remembered within a batch: both bound the worker's memory.
_VOTE_TOKENS = 1 << 14
_KNOWN_DIGESTS = 1 << 16


def _simhash_one(text, digests: dict) -> list | None:
    if text is None:
        return None
    tokens = set(_SPLIT_RE.split(text))
    tokens.discard("")
    if not tokens:
        return None
    if len(digests) > _KNOWN_DIGESTS:
        digests.clear()
    ordered = list(tokens)
    votes = np.zeros(256, dtype=np.int64)
    for first in range(0, len(ordered), _VOTE_TOKENS):
        part = ordered[first:first + _VOTE_TOKENS]
        data = []
        for t in part:
            d = digests.get(t)
            if d is None:
                d = digests[t] = hashlib.sha256(t.encode("utf-8")).digest()
            data.append(d)
        bits = np.unpackbits(np.frombuffer(b"".join(data), dtype=np.uint8)).reshape(len(part), 256)
        votes += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(tokens)).view(">i8").astype(np.int64).tolist()


@F.arrow_udf(T.ArrayType(T.LongType()))
def simhash_words(texts: pa.Array) -> pa.Array:
    """SimHash-256 of each text as four signed 64-bit words, MSB first; NULL if no token.

    A token that several texts of the batch share is hashed once. One text at a time leaves the Arrow batch, and the
    words go back in flat arrays, so a worker holds the batch, one text and the remembered digests.
    """
    digests: dict = {}
    words, found = np.zeros((len(texts), 4), dtype=np.int64), np.zeros(len(texts), dtype=bool)
    for i in range(len(texts)):
        one = _simhash_one(texts[i].as_py(), digests)
        if one is not None:
            words[i], found[i] = one, True
    ends = np.concatenate([[0], np.cumsum(4 * found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words[found].ravel(), pa.int64()), mask=pa.array(~found))


def vector_fingerprint(embedding: str, dims: int = 64) -> Column:
    """One BIGINT: bit i (MSB first) set when element i >= the (dims/2+1)-th smallest.

    Same as "above the median" for distinct values, without float averaging.
    NULL unless the vector has exactly ``dims`` elements.
    """
    e = embedding
    return F.expr(    # sorted once: the outer lambda binds the threshold
        f"CASE WHEN size({e}) = {dims} THEN transform(array(element_at(sort_array({e}), {dims // 2 + 1})), "
        f"t -> aggregate(sequence(0, {dims - 1}), 0L, (acc, i) -> acc | "
        f"IF(element_at({e}, i + 1) >= t, shiftleft(1L, {dims - 1} - i), 0L)))[0] END")


DCT_SCALE = 1 << 12


def dct_basis(n: int) -> list[int]:
    """The n x n cosines of the DCT-II in rows by frequency, times DCT_SCALE and rounded."""
    return [round(math.cos(math.pi * (2 * x + 1) * u / (2 * n)) * DCT_SCALE) for u in range(n) for x in range(n)]


def gray_levels(values: str, size: int) -> Column:
    """``values`` (size * size numbers) as gray levels 0 to 255 from the least to the largest; NULL for another length or NULLs."""
    return F.expr(
        f"CASE WHEN size({values}) = {size * size} AND forall({values}, x -> x IS NOT NULL) THEN "
        f"transform({values}, x -> CAST(COALESCE(FLOOR((CAST(x AS DOUBLE) - array_min({values})) * 255.0D / "
        f"NULLIF(CAST(array_max({values}) AS DOUBLE) - array_min({values}), 0.0D)), 0) AS BIGINT)) END")


def dct_hash(pixels: str, size: int = 8, keep: int = 8) -> Column:
    """The DCT hash of a gray picture in rows, an array of ``size`` * ``size`` whole numbers: keep * keep / 64 words.

    A bit is set where a coefficient of the ``keep`` x ``keep`` lowest frequencies is above their median.
    Cosines are scaled whole numbers, so sums are exact and the same on every engine.
    """
    basis = "array(" + ", ".join(f"{c}L" for c in dct_basis(size)) + ")"
    n, k = size, keep
    rows = (f"transform(sequence(0, {n * k - 1}), i -> aggregate(sequence(0, {n - 1}), 0L, "
            f"(s, x) -> s + {pixels}[(i div {k}) * {n} + x] * b[(i % {k}) * {n} + x]))")
    both = (f"transform(sequence(0, {k * k - 1}), i -> aggregate(sequence(0, {n - 1}), 0L, "
            f"(s, y) -> s + t[y * {k} + i % {k}] * b[(i div {k}) * {n} + y]))")
    middle = f"sort_array(c)[{k * k // 2 - 1}] + sort_array(c)[{k * k // 2}]"
    words = (f"transform(sequence(0, {k * k // 64 - 1}), w -> aggregate(sequence(0, 63), 0L, "
             f"(s, j) -> shiftleft(s, 1) | IF(2 * c[w * 64 + j] > m, 1L, 0L)))")
    # each value is computed once: an outer lambda binds it
    return F.expr(f"CASE WHEN {pixels} IS NOT NULL THEN transform(array({basis}), b -> transform(array({rows}), t -> "
                  f"transform(array({both}), c -> transform(array({middle}), m -> {words})[0])[0])[0])[0] END")


# ---------------------------------------------------------------------------
# image pHash (DCT hash, Zauner 2010): gray -> 64x64 area average -> 2-D DCT-II
# -> top-left 16x16 block -> bit = coefficient > median of the block
# ---------------------------------------------------------------------------
PHASH_SIZE = 16
PHASH_FACTOR = 4


def _area_matrix(size: int, n: int) -> np.ndarray:
    """(n, size) weights of an exact area (box) resample from ``size`` to ``n`` samples."""
    edges = np.arange(n + 1) * (size / n)
    j = np.arange(size)
    lo = np.maximum(edges[:-1, None], j[None, :])
    hi = np.minimum(edges[1:, None], j[None, :] + 1)
    w = np.clip(hi - lo, 0.0, None)
    return w / w.sum(axis=1, keepdims=True)


def _dct_matrix(n: int) -> np.ndarray:
    k = np.arange(n).reshape(-1, 1)
    i = np.arange(n).reshape(1, -1)
    return np.cos(np.pi * (2 * i + 1) * k / (2 * n))


_DCT64 = _dct_matrix(PHASH_SIZE * PHASH_FACTOR)


def _phash_one(data, height, width, channels) -> list | None:
    if data is None or not height or not width or height <= 0 or width <= 0:
        return None
    px = np.frombuffer(data, dtype=np.uint8).astype(np.float64)
    if px.size != height * width * channels:
        return None
    px = px.reshape(height, width, channels)
    if channels >= 3:   # Spark's image source stores B, G, R(, A)
        gray = px[:, :, 2] * 0.299 + px[:, :, 1] * 0.587 + px[:, :, 0] * 0.114
    else:
        gray = px[:, :, 0]
    n = PHASH_SIZE * PHASH_FACTOR
    small = _area_matrix(height, n) @ gray @ _area_matrix(width, n).T
    coeff = (_DCT64 @ small @ _DCT64.T)[:PHASH_SIZE, :PHASH_SIZE]
    coeff = np.round(coeff, 6)       # flat pictures: keep float noise out of the bits
    bits = (coeff > np.median(coeff)).reshape(-1)
    return np.packbits(bits).view(">i8").astype(np.int64).tolist()


@F.pandas_udf(T.ArrayType(T.LongType()))
def phash_words(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    """256-bit DCT perceptual hash of decoded pixels as four words, MSB first."""
    return pd.Series([_phash_one(d, h, w, c) for d, h, w, c in zip(data, height, width, channels)],
                     dtype=object)
