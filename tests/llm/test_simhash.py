import random

import xxhash
from pyspark.sql import functions as F

from tamiz.llm import simhash
from tamiz.llm.common import components


def fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """component of each row by comparing all fingerprints."""
    prints = [fingerprint(t) for _, t in rows]
    own = list(range(len(rows)))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                own[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted((str(d), f"{p:016x}", str(low.get(find(i)))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))


def ours(docs):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.query(docs).collect())


def test_matches_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert ours(documents) == brute(rows)


def test_odd_rows(odd, empty):
    assert ours(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert ours(empty) == []


def test_spark_hash_is_the_contract_hash(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert h % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_large_segments_take_the_exact_way(spark):
    rnd = random.Random(3)
    fps = set()
    for _ in range(6):
        x = rnd.getrandbits(64)
        for _ in range(40):
            y = x
            for _ in range(rnd.randint(0, 3)):
                y ^= 1 << rnd.randrange(64)
            fps.add(y)
    fps = [f - 2**64 if f >= 2**63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")

    def groups(bucket):
        return {(r.node, r.root) for r in components(simhash.links(nodes, bucket=bucket)).collect()}

    assert groups(10_000) == groups(1) == groups(8)
    pairs = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) % 2**64).bit_count() <= 2}
    assert {(r.a, r.b) for r in simhash.links(nodes, bucket=10_000).collect()} == pairs


def test_one_document_of_each_group_stays(odd, make):
    kept = simhash.dedup(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == ["1", "10", "11", "4", "5", "6", "8", "9", "None"]
    copies = make([(i, "exactly the same words here") for i in range(50)] + [(99, "quite another text stands here")])
    assert sorted(r.doc_id for r in simhash.dedup(copies).collect()) == [0, 99]


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
