"""Filters and rankings by Hamming distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions import measures as m


def distance(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows with distance: the differing bits of two columns of one kind, text or bytes, or arrays of 64-bit words; null where
    their lengths differ."""
    kinds = {dict(rows.dtypes)[c] for c in (a, b)}
    if kinds <= {"string", "binary"}:
        d = m.hamming_bits(F.col(a), F.col(b))
    elif kinds == {"array<bigint>"}:
        d = m.hamming_words(F.col(a), F.col(b))
    else:
        raise TypeError(f"no Hamming distance of {' and '.join(sorted(kinds))}")
    return rows.withColumn("distance", d)


def attribute_distance(rows: DataFrame, target: list[int], most: int) -> DataFrame:
    """Rows(attributes) within `most` differing bits of the target bitmap, with the distance; of other sizes, none."""
    d = m.hamming_words(F.col("attributes"), m.bitmap(target))
    return rows.where(F.size("attributes") == len(target)).withColumn("distance", d).where(F.col("distance") <= most)


def sku_typos(rows: DataFrame, code: str, column: str = "sku") -> DataFrame:
    """Rows whose code has the bytes' length and differs from it in exactly one bit."""
    sku = F.col(column)
    return rows.where(F.octet_length(sku) == len(code.encode())).where(m.hamming_bits(sku, F.lit(code)) == 1)


def position_typos(rows: DataFrame, code: str, column: str = "sku") -> DataFrame:
    """Rows whose code differs in exactly one position: what sku_typos is for characters instead of bits."""
    sku = F.col(column)
    return rows.where(F.char_length(sku) == len(code)).where(m.hamming_positions(sku, F.lit(code)) == 1)
