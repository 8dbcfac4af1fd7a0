"""Sequence kernels that built-in functions don't express, in plain Python, and their Arrow UDFs."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_GRAPHEME = regex.compile(r"\X")


def clusters(s: str) -> list[str]:
    """Extended grapheme clusters of a string."""
    return list(s) if s.isascii() and "\r" not in s else _GRAPHEME.findall(s)


def prepared(s: str) -> list[str]:
    """What edit distances compare; the same as functions.text.preprocess."""
    return clusters(unicodedata.normalize("NFC", s).lower())


def jaro_winkler(a: str, b: str, scale: float = 0.1, prefix: int = 4) -> float | None:
    """Jaro-Winkler similarity; None where the measure has no value: a side of over 64 graphemes, or one empty side.

    The common-prefix bonus has no lower limit of similarity. If the lengths differ by twice the matching window or more,
    the result is 0.
    """
    x, y = clusters(a), clusters(b)
    if len(x) > 64 or len(y) > 64:
        return None
    if not x and not y:
        return 1.0
    if not x or not y:
        return None
    reach = max(0, max(len(x), len(y)) // 2 - 1)
    if reach > 0 and abs(len(x) - len(y)) >= 2 * reach:
        return 0.0
    free, hits = set(range(len(y))), []
    for i, g in enumerate(x):
        j = next((j for j in range(max(0, i - reach), min(len(y), i + reach + 1)) if j in free and y[j] == g), None)
        if j is not None:
            free.discard(j)
            hits.append((i, j))
    if not hits:
        return 0.0
    crossed = sum(x[i] != y[j] for (i, _), j in zip(hits, sorted(j for _, j in hits), strict=True)) // 2
    m = len(hits)
    jaro = (m / len(x) + m / len(y) + (m - crossed) / m) / 3
    same = 0
    while same < min(prefix, len(x), len(y)) and x[same] == y[same]:
        same += 1
    return min(1.0, jaro + same * scale * (1 - jaro))


def true_damerau(x: list[str], y: list[str], numeric_weight: int = 0, most: int | None = None) -> int | None:
    """Edits between two sequences: insertions, deletions and swaps of neighbours, between which others may be edited, cost
    1; a substitution costs 1, or numeric_weight between different ASCII digits. None if beyond `most`.

    Rows are kept for the last place of each symbol of x only, as a swap looks no further back.
    """
    if most is not None and abs(len(x) - len(y)) > most:
        return None
    if not x or not y:
        d = len(x) + len(y)
        return d if most is None or d <= most else None
    rows: dict[str, tuple[int, list[int]]] = {}  # by symbol: its last place in x, and the row before that place
    above = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        row, last = [i], 0  # last: the last place in y, left of here, of this row's symbol
        for j, b in enumerate(y, 1):
            if a == b:
                cost = 0
            elif a.isascii() and b.isascii() and a.isdigit() and b.isdigit():
                cost = numeric_weight
            else:
                cost = 1
            d = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + cost)
            if last and b in rows:
                k, before = rows[b]
                d = min(d, before[last - 1] + (i - k - 1) + 1 + (j - last - 1))
            row.append(d)
            if a == b:
                last = j
        rows[a] = (i, above)
        above = row
    d = above[-1]
    return d if most is None or d <= most else None


def damerau_distance(a: Column, b: Column, numeric_weight: int = 0, most: int | None = None) -> Column:
    """Damerau-Levenshtein distance of two strings after preprocessing; null beyond `most`."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = [None if x is None or y is None else true_damerau(prepared(x), prepared(y), numeric_weight, most) for x, y in zip(a, b, strict=True)]
        return pd.Series(out, dtype="Int32")

    return run(a, b)


def jaro_winkler_similarity(a: Column, b: Column, scale: float = 0.1, prefix: int = 4) -> Column:
    """Jaro-Winkler similarity; null where it has no value."""
    if not 0 <= scale <= 0.25 or not 0 <= prefix <= 4:
        raise ValueError("scale must be in [0, 0.25] and prefix in [0, 4]")

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else jaro_winkler(x, y, scale, prefix) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(a, b)


#: Length of mock embeddings.
DIM = 768
# Offset and prime of 64-bit FNV-1a; multiplier and increment of the generator that it seeds.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
LCG_A, LCG_C = 6364136223846793005, 1442695040888963407


def _lcg_steps(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and increments that take a seed to the generator's 1st to dim-th state at once."""
    a, c, out = 1, 0, []
    for _ in range(dim):
        a, c = a * LCG_A % 2**64, (c * LCG_A + LCG_C) % 2**64
        out.append((a, c))
    return np.array([x for x, _ in out], dtype=np.uint64), np.array([x for _, x in out], dtype=np.uint64)


def mock_vectors(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Pseudorandom unit vectors that equal texts share: a generator seeded by the hash of the text's bytes."""
    seeds = []
    for text in texts:
        h = FNV_OFFSET
        for byte in text.encode("utf-8", "surrogatepass"):
            h = (h ^ byte) * FNV_PRIME % 2**64
        seeds.append(h)
    a, c = _lcg_steps(dim)
    states = np.array(seeds, dtype=np.uint64)[:, None] * a + c
    v = (states >> np.uint64(33)).astype(np.float32) / np.float32(2**32 - 1) * np.float32(2) - np.float32(1)
    norm = np.sqrt(np.sum(v * v, axis=1, dtype=np.float32))[:, None]
    return np.where(norm > 1e-10, v / np.where(norm > 1e-10, norm, 1), v).astype(np.float32)


def mock_embedding(c: Column, dim: int = DIM) -> Column:
    """Mock embeddings of a text column."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(mock_vectors([x or "" for x in s], dim)))

    return run(c)
