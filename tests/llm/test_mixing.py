import re
from collections import defaultdict

from pyspark.sql import functions as F

from tamiz.llm import mixing


def want_targets(sizes):
    """sizes by source -> target, by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / open_ for s in names}
        more = {s for s in names if target[s] > 3 * sizes[s] + 1e-9}
        if not more:
            return target
        full |= more


def check(docs):
    rows = mixing.query(docs).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(r.doc_id), words(r.text)) for r in docs.collect())
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = want_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert target[s] <= taken[s] + 1e-6 and taken[s] < target[s] + 1
    return sorted((str(r.doc_id), r.taken) for r in rows)


def test_contract_and_reruns(documents):
    assert check(documents) == check(documents.repartition(7))


def test_small_and_capped_sources(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(1, "a"), (2, "b"), (3, None), (1000, "c"), (0, "d"), (5000, "e"), (1, "a")])]
    check(spark.createDataFrame([*rows, (9, None, "z"), (0, "w ", "a")], "doc_id long, text string, source string"))


def test_odd_and_empty(odd, empty):
    check(odd)
    assert mixing.query(empty).count() == 0


def test_pieces_are_the_mix(documents):
    rows, sources = mixing.packed(documents, 64, 2000, 11)
    slots = mixing.draw(sources, 64, 256, 11)
    got = mixing.pieces(rows, slots, 64).groupBy("doc_id").agg(F.sum("words").alias("n"))
    want = {r.doc_id: r.taken for r in mixing.mix(documents).collect() if r.taken}
    assert {r.doc_id: r.n for r in got.collect()} == want
    sizes = slots.groupBy("shard").count().orderBy("shard").collect()
    assert all(r["count"] == 256 for r in sizes[:-1])
    assert slots.select("shard", "slot").distinct().count() == slots.count() == mixing.shard_counts(slots).agg(F.sum("n")).first()[0]
    texts = mixing.mixed_texts(documents, shard=256)
    assert texts.agg(F.sum(F.size(F.split("words", " ")))).first()[0] == sum(want.values())


def test_no_plan_has_python(documents, plans):
    seen = plans(mixing, lambda: mixing.query(documents))
    assert len(seen) > 3 and not any(re.search("Python|Arrow|Pandas", p) for p in seen)


def test_permutations_are_bijections(spark):
    for n in (1, 2, 53, 1060):
        rows = spark.range(n).crossJoin(spark.range(20).withColumnRenamed("id", "k"))
        rows = rows.select("k", mixing.permuted(F.col("id"), F.lit(n), mixing.turns(F.col("k"), 11)).alias("at"))
        seen = rows.groupBy("k").agg(F.countDistinct("at").alias("n"), F.min("at").alias("a"), F.max("at").alias("z")).collect()
        assert {(r.n, r.a, r.z) for r in seen} == {(n, 0, n - 1)}


def test_permutation_of_more_than_32_bits(spark):
    n = 5 * 10**12
    at = [r.at for r in spark.range(0, n, n // 5000).select(mixing.permuted(F.col("id"), F.lit(n), mixing.turns(F.lit(3), 11)).alias("at")).collect()]
    assert len(set(at)) == len(at) and 0 <= min(at) and max(at) < n
    assert abs(sum(at) / len(at) - n / 2) < 0.03 * n and sum(a < b for a, b in zip(at, at[1:])) < 0.55 * len(at)


def test_shard_counts_vary_as_draws_do(spark):
    """A source of 30 % of the slots: its counts for each shard have the mean and the spread of draws without replacement."""
    sources = spark.createDataFrame([(0, 64 * 6000, 64 * 6000.0, 6000, 6000), (1, 64 * 14000, 64 * 14000.0, 14000, 14000)], "k int, source_size long, target double, blocks long, slots long")
    for seed in (11, 12, 13):
        n = [r.n for r in mixing.shard_counts(mixing.draw(sources, 64, 200, seed)).where("k = 0").collect()]
        assert len(n) == 100 and sum(n) == 6000
        spread = (sum((x - 60) ** 2 for x in n) / 100) ** 0.5
        assert 4.5 < spread < 8.5  # expected: 6.5


def test_taken_is_what_the_shards_hold(documents, odd):
    for docs in (documents, odd):
        held = defaultdict(int)
        for r in mixing.mixed_texts(docs, shard=256).collect():
            held[r.doc_id] += len(r.words.split())
        want = defaultdict(int)
        for r in mixing.mix(docs, shard=256).collect():
            want[r.doc_id] += r.taken
        assert held == {d: n for d, n in want.items() if n}
