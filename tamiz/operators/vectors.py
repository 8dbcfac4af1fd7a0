"""Vector search: exact scans, and an index of cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions import measures as m
from tamiz.sources.scratch import scratch


def normalized(rows: DataFrame) -> DataFrame:
    """rows(vec) with unit vectors."""
    return rows.withColumn("vec", m.l2_normalize(F.col("vec")))


def linear_search(rows: DataFrame, query: list[float], k: int, unit: bool) -> DataFrame:
    """(row_idx, label, score): the k best of rows(row_idx, label, vec), by dot product if the vectors are of unit length
    (the query is taken as it is), else by cosine. Ties go to the larger index."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = m.dot(F.col("vec"), q) if unit else m.cosine(F.col("vec"), q)
    right = F.assert_true(F.size("vec") == len(query), F.lit("the query has another length")).isNull()
    scored = rows.select("row_idx", "label", F.when(right, score).cast("float").alias("score"))
    return scored.orderBy(F.desc("score"), F.desc("row_idx")).limit(k)


def distances(rows: DataFrame, query: list[float]) -> DataFrame:
    """rows(vec, ...) with d2, the squared distance from the query."""
    q = np.asarray(query, dtype=np.float64)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            v = np.stack(s.to_numpy()).astype(np.float64) if len(s) else np.zeros((0, len(q)))
            yield pd.Series(((v - q) ** 2).sum(axis=1))

    return rows.withColumn("d2", F.pandas_udf(run, "double")("vec"))


def nearest(rows: DataFrame, query: list[float], k: int) -> DataFrame:
    """rows(row_idx, vec, ...) of the k least squared distances, with d2 and score 1 - d2 / 2; ties in catalogue order."""
    out = distances(rows, query).orderBy("d2", "row_idx").limit(k)
    return out.withColumn("score", m.euclid_score(F.col("d2")))


@dataclass(frozen=True)
class VectorIndex:
    """Vectors in cells around centers. rows has the columns it was built of, and the cell, by which its files are parted;
    radii are the largest distances of a cell's vectors from its center."""

    rows: DataFrame
    centers: np.ndarray
    radii: dict[int, float]


def _means(v: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Centers of up to `cells` groups of vectors."""
    rng = np.random.default_rng(seed)
    centers = v[rng.choice(len(v), min(cells, len(v)), replace=False)]
    for _ in range(rounds):
        to = np.argmin((centers**2).sum(1) - 2 * v @ centers.T, axis=1)
        centers = np.stack([v[to == k].mean(0) if (to == k).any() else c for k, c in enumerate(centers)])
    return centers


def build_index(rows: DataFrame, cells: int = 64, sample: int = 10_000, rounds: int = 8, seed: int = 1) -> VectorIndex:
    """An index of rows(row_idx, vec, ...): centers come from about `sample` vectors, and every vector is in the cell of its
    nearest center. It is written to the shared folder, to be built once and searched often."""
    spark = rows.sparkSession
    count = rows.count()
    share = sample / max(1, count)
    some = rows.where(F.pmod(F.xxhash64("row_idx", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, share))).select("vec").collect()  # about `sample`
    v = np.array([r.vec for r in some] or [r.vec for r in rows.select("vec").limit(1).collect()], dtype=np.float64)
    centers = _means(v, cells, rounds, seed) if len(v) else np.zeros((1, 1))

    @F.pandas_udf("struct<cell: int, far: double>")
    def nearest_center(s: pd.Series) -> pd.DataFrame:
        x = np.stack(s.to_numpy()).astype(np.float64) if len(s) else np.zeros((0, centers.shape[1]))
        d2 = np.maximum(0, (x**2).sum(1)[:, None] + (centers**2).sum(1) - 2 * x @ centers.T)
        return pd.DataFrame({"cell": d2.argmin(1).astype(np.int32), "far": np.sqrt(d2.min(1))})

    path = scratch(spark, "cells")
    placed = rows.withColumn("placed", nearest_center("vec")).select(*rows.columns, "placed.cell", "placed.far")
    # A cell may be large: its rows are dealt to several tasks.
    placed.repartition("cell", F.pmod(F.xxhash64("row_idx"), F.lit(1 + count // 1_000_000))).write.partitionBy("cell").parquet(path)
    held = spark.read.parquet(path) if count else placed
    radii = {r.cell: r.radius for r in held.groupBy("cell").agg(F.max("far").alias("radius")).collect()}  # a row for each cell
    return VectorIndex(held, centers, radii)


def search_index(index: VectorIndex, query: list[float], k: int, probes: int = 4, exact: bool = True) -> DataFrame:
    """The k nearest as nearest() has them. The `probes` cells whose centers are nearest are read first; if `exact`, then all
    those whose radius may hold something as near as the k-th found, else no more."""
    q = np.asarray(query, dtype=np.float64)
    far = {c: float(np.linalg.norm(index.centers[c] - q)) for c in index.radii}
    first = sorted(far, key=far.get)[:probes]
    if exact and len(first) < len(far):
        found = [r.d2 for r in nearest(index.rows.where(F.col("cell").isin(first)), query, k).select("d2").collect()]  # k rows
        bound = max(found) ** 0.5 if len(found) == k else float("inf")
        first = [c for c in far if c in first or far[c] - index.radii[c] <= bound + 1e-6 * (1 + bound)]
    return nearest(index.rows.where(F.col("cell").isin(first)), query, k).drop("cell", "far")
