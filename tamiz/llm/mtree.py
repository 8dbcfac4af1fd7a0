"""Exact top-k inner products by best-first search in M-trees (operator 1).

Components become floor(256 * x), and the largest inner products are made the nearest neighbours of a metric: with R the
largest squared length, each vector x gets the component sqrt(R - |x|^2), each query 0, so that the squared distance is
|q|^2 + R - 2 q.x. Vectors are dealt to the nearest of a bounded number of pivots, and each pivot's vectors, by hash, to
trees of about `tree_rows`, so that no vector or cluster that many rows hold makes one tree large. A tree is a row of
pages: an inner page has routing vectors, their covering radii and their distances to the page's own routing vector; a
leaf has vectors and these distances.

A query goes to the trees of its nearest pivot first, which gives it a bound, the distance of its k-th best; then only to
those trees whose ring around their pivot, from the least to the largest distance of their vectors, may hold something as
near. Within a tree the page of the least possible distance is
read next, until that is beyond the bound; entries whose stored distance to the page's routing vector already puts them
beyond the bound, by the triangle inequality, are skipped without computing theirs. Bounds are held off by a margin for
rounding; scores are computed in whole numbers.

Pivots come from at most `sample` vectors, those of the smallest hashes; every vector is in a tree. Queries are joined to
trees in blocks of `block`. Vectors without clusters, or of many even dimensions, leave the bounds nothing to rule out: then
every query reads every tree, and the work is that of comparing the queries with all rows.

Components stay doubles that hold whole numbers. Where no dot product can leave 53 bits, sums of doubles are exact; else
what the bounds leave is summed in whole numbers of any size. Scores beyond a long are given as the nearest long.

Defined cases: vectors that are null or hold null, NaN or infinite components, or such that are infinite 256 times, take no
part; empty ones do; vectors meet only those of their own length; rows of the same id and vector are one row, of different
vectors of an id the least is its query, and a query meets no row of its own id; a null id is no query, and comes last among
ties; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.common import first_by_hash, maybe_broadcast, stash

LAST = 2**63 - 1
#: A page of a tree: children holds the inner page's pages, ids the leaf's vectors; near are the distances to the page's
#: own routing vector, radii the covering radii, vectors the entries' components in one list.
PAGE = "struct<children: array<int>, ids: array<bigint>, vectors: array<double>, near: array<double>, radii: array<double>>"
#: Products below are exact in doubles.
EXACT = 2.0**53
#: Scores on the way, and the largest that are told apart.
SCORE, LARGEST = pa.decimal128(38, 0), 10**38 - 1


def whole(rows: DataFrame) -> DataFrame:
    """(vec_id, v, n2, dim) of rows(vec_id, embedding): components as whole numbers, the squared length and the length."""
    x256 = lambda x: x.cast("double") * 256
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x256(x)) & (F.abs(x256(x)) < float("inf")))
    # Beyond 53 bits a double is whole, and floor() would make it a long.
    v = F.transform("embedding", lambda x: F.when(F.abs(x256(x)) < EXACT, F.floor(x256(x)).cast("double")).otherwise(x256(x)))
    rows = rows.where(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).distinct()
    return rows.select("vec_id", "v", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("n2"), F.size("v").alias("dim"))


def lifted(v: np.ndarray, n2: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that makes all of them equally long."""
    return np.hstack([v.astype(np.float64), np.sqrt(np.maximum(0, most - n2.astype(np.float64)))[:, None]])


def distances(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = points - q
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def farthest(points: np.ndarray, k: int) -> list[int]:
    """Indexes of up to k points, each the farthest from those before it."""
    chosen, d = [0], distances(points, points[0])
    while len(chosen) < k and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, distances(points, points[chosen[-1]]))
    return chosen


def build(ids: np.ndarray, v: np.ndarray, points: np.ndarray, center: np.ndarray, leaf: int = 256, fanout: int = 16) -> list[dict[str, Any]]:
    """Pages of a tree; the first is the root, whose routing vector is `center`."""
    pages: list[dict[str, Any]] = []
    rng = np.random.default_rng(len(ids))

    def grow(rows: np.ndarray, own: np.ndarray) -> int:
        at = len(pages)
        pages.append({})
        near = distances(points[rows], own)
        if len(rows) <= leaf:
            pages[at] = {"children": [], "ids": ids[rows].tolist(), "vectors": v[rows].ravel().tolist(), "near": near.tolist(), "radii": []}
            return at
        # As many routing vectors as fill pages, drawn at random: the parts are then about even.
        wanted = min(fanout, -(-len(rows) // leaf) + 1)
        heads = rng.choice(rows, wanted, replace=False)
        heads = heads[np.unique(points[heads], axis=0, return_index=True)[1]]
        if len(heads) == 1:  # copies of one vector, or nearly: parts of equal size
            parts = [(int(p[0]), p) for p in np.array_split(rows, min(fanout, -(-len(rows) // leaf)))]
        else:
            to = np.argmin(np.stack([distances(points[rows], points[h]) for h in heads]), axis=0)
            parts = [(int(h), rows[to == i]) for i, h in enumerate(heads) if (to == i).any()]
        entry: dict[str, list] = {"children": [], "ids": [], "vectors": [], "near": [], "radii": []}
        for h, part in parts:
            entry["children"].append(grow(part, points[h]))
            entry["vectors"] += v[h].tolist()
            entry["near"].append(float(distances(points[h][None], own)[0]))
            entry["radii"].append(float(distances(points[part], points[h]).max()))
        pages[at] = entry
        return at

    grow(np.arange(len(ids)), center)
    return pages


class Tree:
    """A tree read for search; the last component of its vectors follows from the others."""

    def __init__(self, pages: list[dict[str, Any]], dim: int, most: float) -> None:
        self.most = most
        self.pages = []
        for p in pages:
            near = np.asarray(p["near"], dtype=np.float64)
            v = np.asarray(p["vectors"], dtype=np.float64).reshape(len(near), dim)
            self.pages.append((np.asarray(p["children"], dtype=np.int64), np.asarray(p["ids"], dtype=np.int64), v, near, np.asarray(p["radii"], dtype=np.float64)))
        self.computed = self.entries = 0

    def search(self, own: int, q: np.ndarray, to_root: float, k: int, bound: float) -> list[tuple[int, int]]:
        """Up to k (score, id) of the best; none of those beyond the bound need be there. to_root: distance to the root's vector."""
        q2 = float(q @ q)
        base = q2 + self.most
        exact = (q2 * self.most) ** 0.5 < EXACT
        margin = (1e-9 if exact else 1e-6) * (1 + base) ** 0.5
        off = 0.0 if exact else 2.0**-50 * (len(q) + 1) * (q2 * self.most) ** 0.5  # of a dot product in doubles
        whole = [] if exact else [int(x) for x in q]
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first
        heap = [(0.0, 0, to_root)]
        while heap:
            least, page, d = heapq.heappop(heap)
            if least > bound + margin:
                break
            children, ids, v, near, radii = self.pages[page]
            self.entries += len(near)
            low = np.abs(d - near)
            if len(children):
                low = low - radii
            some = np.flatnonzero(low <= bound + margin)
            if not len(some):
                continue
            self.computed += len(some)
            dots = (v if len(some) == len(near) else v[some]) @ q
            if len(children):
                far = np.sqrt(np.maximum(0.0, base - 2 * dots))
                low = np.maximum(far - radii[some], low[some])
                for i in np.flatnonzero(low <= bound + margin):
                    heapq.heappush(heap, (max(0.0, float(low[i])), int(children[some[i]]), float(far[i])))
                continue
            if len(best) == k:
                keep = dots + off >= best[0][0]
                dots, some = dots[keep], some[keep]
            scores = map(int, dots.tolist()) if exact else (sum(int(a) * b for a, b in zip(v[i], whole, strict=True)) for i in some)
            for s, i in zip(scores, ids[some].tolist(), strict=True):
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                bound = min(bound, max(0.0, base - 2 * best[0][0]) ** 0.5)
        return [(s, -i) for s, i in best]


def choose_pivots(rows: DataFrame, most: float, count: int, sample: int, each: int, limit: int) -> dict[int, np.ndarray]:
    """Pivots for each vector length, as lifted vectors, of a sample of at most `sample` vectors."""
    got = first_by_hash(rows, F.xxhash64("vec_id", "v"), sample).select("v", "n2", "dim").collect()
    pivots = {}
    for dim in sorted({r.dim for r in got}):
        v = np.array([r.v for r in got if r.dim == dim], dtype=np.float64)
        v = v.reshape(len(v), dim)
        n2 = np.array([r.n2 for r in got if r.dim == dim])
        points = lifted(v, n2, most)
        pivots[dim] = points[farthest(points, max(1, min(limit, -(-count // each))))]
    return pivots


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, tree_rows: int = 4096, sample: int = 2048, pivots: int = 128, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each of queries(vec_id, v, n2, dim) with rows of
    the same columns, ties to the smaller vec_id; not with those of the query's own id."""
    spark = rows.sparkSession
    count, most = rows.agg(F.count("*"), F.max("n2")).first()
    most = float(most or 0)
    centers = choose_pivots(rows, most, count, sample, 2 * tree_rows, pivots)
    held = spark.sparkContext.broadcast(centers)  # at most `pivots` vectors of each length in the sample

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df = batch.to_pandas()
            pivot, far = np.zeros(len(df), dtype=np.int32), np.zeros(len(df))
            for dim, part in df.groupby("dim"):
                points = lifted(np.array(part["v"].tolist(), dtype=np.float64).reshape(len(part), dim), part["n2"].to_numpy(), most)
                d = np.stack([distances(points, c) for c in held.value.get(dim, np.zeros((1, dim + 1)))])
                pivot[part.index], far[part.index] = d.argmin(0), d.min(0)
            yield pa.record_batch([*(batch.column(c) for c in ("vec_id", "v", "n2", "dim")), pa.array(pivot), pa.array(far)], names=["vec_id", "v", "n2", "dim", "pivot", "far"])

    dealt = stash(rows.mapInArrow(deal, "vec_id long, v array<double>, n2 double, dim int, pivot int, far double"), "dealt")
    groups = dealt.groupBy("dim", "pivot").agg(F.count("*").alias("n"))
    groups = stash(groups.select("dim", "pivot", F.ceil(F.col("n") / tree_rows).cast("int").alias("parts")), "groups")
    sized = dealt.join(maybe_broadcast(groups, groups.count(), 24), ["dim", "pivot"])
    sized = stash(sized.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), "parts").cast("int")).drop("parts"), "sized")
    # A tree's vectors are between these distances of its pivot.
    rings = stash(sized.groupBy("dim", "pivot", "part").agg(F.min("far").alias("low"), F.max("far").alias("high")), "rings")

    def grow(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        dim, pivot, part = (int(x) for x in key)
        ids = df["vec_id"].astype("Int64").fillna(LAST).to_numpy(dtype=np.int64)
        v = np.array(df["v"].tolist(), dtype=np.float64).reshape(len(df), dim)
        order = np.argsort(ids, kind="stable")
        center = held.value.get(dim, np.zeros((1, dim + 1)))[pivot]
        pages = build(ids[order], v[order], lifted(v, df["n2"].to_numpy(), most)[order], center)
        return pd.DataFrame({"dim": [dim], "pivot": [pivot], "part": [part], "pages": [pages]})

    trees = stash(sized.groupBy("dim", "pivot", "part").applyInPandas(grow, f"dim int, pivot int, part int, pages array<{PAGE}>"), "trees")
    reach = rings.groupBy("dim", "pivot").agg(F.collect_list(F.struct("part", "low", "high")).alias("rings"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and pivot of its length, with the distance."""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                q = np.append(np.asarray(r["v"], dtype=np.float64), 0.0)
                d = distances(held.value.get(r["dim"], np.zeros((1, r["dim"] + 1))), q)
                bound = float("inf") if r["bound"] is None else r["bound"]
                out += [(r["vec_id"], r["v"], r["dim"], i, float(x), bound, bool(x == d.min())) for i, x in enumerate(d)]
            cols = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["q", "qv", "dim", "pivot", "to_root", "bound", "nearest"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                tree, out = Tree(r["pages"], r["dim"], most), []
                for q in r["qs"]:
                    for score, vec in tree.search(q["q"], np.asarray(q["qv"], dtype=np.float64), q["to_root"], k, q["bound"]):
                        out.append((q["q"], None if vec == LAST else vec, Decimal(max(-LARGEST, min(LARGEST, score)))))
                cols = list(zip(*out, strict=True)) or [()] * 3
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), SCORE), strict=True)], names=["q", "vec_id", "score"])

    def search(asked: DataFrame, first: bool) -> DataFrame:
        """Queries in the trees of their nearest pivot, or in those of the others that their bound doesn't rule out."""
        sent = asked.mapInArrow(measured, "q long, qv array<double>, dim int, pivot int, to_root double, bound double, nearest boolean")
        sent = sent.where("nearest" if first else "not nearest").join(F.broadcast(reach), ["dim", "pivot"])  # 24 bytes a tree
        sent = sent.select("q", "qv", "dim", "pivot", "to_root", "bound", F.explode("rings").alias("r"))
        least = F.greatest(F.col("to_root") - F.col("r.high"), F.col("r.low") - F.col("to_root"))
        sent = sent.where(least <= F.col("bound")).withColumn("b", F.pmod(F.xxhash64("q"), F.lit(max(1, -(-wanted // block)))))
        blocks = sent.groupBy("dim", "pivot", F.col("r.part").alias("part"), "b").agg(F.collect_list(F.struct("q", "qv", "to_root", "bound")).alias("qs"))  # about `block` queries
        joined = blocks.join(trees, ["dim", "pivot", "part"]).repartition(max(8, spark.sparkContext.defaultParallelism), "dim", "pivot", "part", "b")
        return stash(joined.select("dim", "pages", "qs").mapInArrow(look, "q long, vec_id long, score decimal(38,0)"), "found")

    order = Window.partitionBy("q").orderBy(F.desc("score"), F.coalesce("vec_id", F.lit(LAST)))
    wanted = queries.count()
    near = search(queries.withColumn("bound", F.lit(None).cast("double")), True)
    kth = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("q").alias("vec_id"), F.col("score").cast("double").alias("kth"))
    base = F.col("n2") + F.lit(most)
    # Off by more than rounding; none for a query that has met fewer than k rows.
    bound = F.when(F.col("kth").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), base - 2 * F.col("kth"))) + 1e-6 * F.sqrt(1 + base))
    every = near.unionByName(search(queries.join(kth, "vec_id", "left").withColumn("bound", bound), False))
    every = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.greatest(F.lit(-LAST - 1).cast("decimal(38,0)"), F.least(F.lit(LAST).cast("decimal(38,0)"), F.col("score")))
    return every.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", score.cast("long").alias("score"))


def query(embeddings: DataFrame) -> DataFrame:
    """The five best rows of each row whose vec_id is divisible by 50, by the contract of operator 1."""
    rows = stash(whole(embeddings), "vectors")
    asked = rows.where("vec_id % 50 = 0").groupBy("vec_id").agg(F.min(F.struct("v", "n2", "dim")).alias("x")).select("vec_id", "x.*")
    return top_k(rows, asked)


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, r.vec_id,
         CAST(list_sum([q.v[i] * r.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.v) = len(r.v) WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5
"""
