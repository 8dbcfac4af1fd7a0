import math
import random

import numpy as np

from tamiz.llm import mtree


def brute(rows, k=5, single=True):
    v = {}
    for i, x in rows:
        if x is not None and all(c is not None and math.isfinite(c) for c in x):
            v[i] = [math.floor(256 * (float(np.float32(c)) if single else c)) for c in x]
    out = set()
    for q in v:
        if q is not None and q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=True)), math.inf if i is None else i, i) for i in v if i != q and len(v[i]) == len(v[q]))[:k]
            out |= {(q, r, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, _, i) in enumerate(best, 1)}
    return out


def ours(df, **kw):
    rows = mtree.whole(df)
    return {tuple(r) for r in mtree.top_k(rows, rows.where("vec_id % 50 = 0"), **kw).collect()}


def test_matches_sql(spark, sf):
    from oracle import compare, connect

    assert compare(mtree.query(spark.read.parquet(f"{sf}/embeddings.parquet")), connect(sf), mtree.SQL) == ""


def test_clusters_copies_and_ties(spark):
    rnd = random.Random(1)
    centers = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [c + rnd.gauss(0, 0.1) for c in centers[i % 5]]) for i in range(600)]
    rows += [(1000 + i, centers[0]) for i in range(300)]  # a third of all rows are copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert ours(df, tree_rows=100, pivots=6, block=4) == brute(rows) == ours(df, tree_rows=5000)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [0.5]), (1, [0.25]), (2, [-0.1]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (None, [3.0, 3.0]), (7, [1.0, 2.0]), (8, []), (100, []), (9, [1e30, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert ours(df.unionByName(df)) == brute(rows)
    assert mtree.query(df.limit(0)).count() == 0


def test_large_components_are_whole_numbers(spark):
    """Products beyond 53 bits, and ties that differ in the last bit alone."""
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-2e5, 2e5) for _ in range(64)]) for i in range(200)]
    rows += [(1000 + i, [x + rnd.choice([0, 1 / 256]) for x in rows[0][1]]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, single=False)
    assert ours(df, tree_rows=60, pivots=4) == want
    assert any(abs(s) > 2**53 for *_, s in want)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 1, [2], 3, "x"), (1, [2.0], 1, [2], 3, "y")], "vec_id long, embedding array<float>, n2 int, v array<int>, dim int, hash string")
    assert {tuple(r) for r in mtree.query(df).collect()} == {(0, 1, 1, 256 * 512)}


def test_far_trees_are_ruled_out(spark):
    """Of clusters far apart a query reads its own: the others' rings are beyond its bound."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=16) * 0.01 + 10 * np.eye(16)[i % 8]).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ours(df, tree_rows=100, pivots=8) == brute(rows, single=False)


def test_bounds_save_computations():
    rng = np.random.default_rng(0)
    v = (rng.normal(size=(20, 8))[rng.integers(0, 20, 4000)] * 200 + rng.normal(size=(4000, 8)) * 5).astype(int)
    n2 = (v * v).sum(1)
    most = float(n2.max())
    points = mtree.lifted(v, n2, most)
    pages = mtree.build(np.arange(4000), v, points, points[0], 64, 8)
    assert sum(len(p["ids"]) for p in pages) == 4000
    tree = mtree.Tree(pages, 8, most)
    for i in range(40):
        q = v[i].astype(float)
        d = float(mtree.distances(points[:1], np.append(q, 0.0))[0])
        got = sorted(tree.search(i, q, d, 5, float("inf")), key=lambda x: (-x[0], x[1]))
        dots = v @ v[i]
        want = sorted(((int(s), j) for j, s in enumerate(dots) if j != i), key=lambda x: (-x[0], x[1]))[:5]
        assert got == want
    assert tree.computed < 0.5 * 40 * 4000
