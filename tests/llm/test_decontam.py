import random
import re

from tamiz.llm import decontam

WORDS = [f"w{i}" for i in range(4000)]


def tokens(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def brute(docs, items, window=16, agree=0.8):
    """(doc, item) for which some window of the item agrees along some diagonal."""
    out = set()
    for d, t in docs:
        x = tokens(t)
        for i, u in items:
            y = tokens(u)
            w = min(window, len(y))
            if not y:
                continue
            for diag in range(-len(y) + 1, len(x)):
                same = [0 <= diag + j < len(x) and x[diag + j] == y[j] for j in range(len(y))]
                if any(sum(same[s : s + w]) >= -(-w * agree // 1) for s in range(len(y) - w + 1)):
                    out.add((d, i))
                    break
    return out


def planted(seed=1):
    rnd = random.Random(seed)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(16, 50)))) for i in range(20)]
    docs = []
    for d in range(60):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(20, 200))]
        if d % 3 == 0:
            copy = items[rnd.randrange(20)][1].split()
            for _ in range(len(copy) // 10):
                copy[rnd.randrange(len(copy))] = "changed"
            at = rnd.randint(0, len(words))
            words[at:at] = [w.upper() for w in copy]
        docs.append((d, ", ".join(words)))
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force_on_planted_passages(spark):
    docs, items = planted()
    got = {(r.doc_id, r.item_id) for r in decontam.query(*frames(spark, docs, items)).collect()}
    want = brute(docs, items)
    assert got == want and {d for d, _ in want} >= {d for d in range(0, 60, 3)}


def test_masks_cover_every_allowed_substitution():
    import math

    for n in range(1, 17):
        assert decontam.complete(n, n - math.ceil(0.8 * n))
    assert not decontam.complete(10, 4)


def test_equals_brute_force_at_every_length(spark):
    """As many substitutions as are allowed, and one more, at random places of items of 1 to 20 tokens."""
    rnd = random.Random(7)
    docs, items = [], []
    for n in [*range(1, 21), 30]:
        for _ in range(6):
            item = [rnd.choice(WORDS) for _ in range(n)]
            items.append((len(items), " ".join(item)))
            w = min(16, n)
            for more in (0, 1):
                copy = list(item)
                for i in rnd.sample(range(w), min(w, w - -(-w * 4 // 5) + more)):
                    copy[i] = "changed"
                around = [rnd.choice(WORDS) for _ in range(10)]
                docs.append((len(docs), " ".join([*around[:5], *copy, *around[5:]])))
    got = {(r.doc_id, r.item_id) for r in decontam.query(*frames(spark, docs, items)).collect()}
    assert got == brute(docs, items)


def test_shuffled_way_is_the_same(spark, monkeypatch):
    docs, items = planted(2)
    d, b = frames(spark, docs, items)
    rows = lambda: sorted(map(tuple, decontam.matches(d, b).collect()))
    first = rows()
    monkeypatch.setattr("tamiz.llm.common.BROADCAST_BYTES", 0)
    assert rows() == first != []


def test_short_items_are_found_exactly(spark):
    docs = [(1, "one two three four"), (2, "two three"), (3, "two tree"), (None, "zero two three"), (2, "two three")]
    d, b = frames(spark, docs, [(1, "Two, three!"), (2, "four"), (3, ""), (4, None), (1, "Two, three!")])
    got = sorted((str(r.doc_id), r.item_id, r.start) for r in decontam.query(d, b).collect())
    assert got == [("1", 1, 1), ("1", 2, 3), ("2", 1, 0), ("None", 1, 1)]
    assert sorted(str(r.doc_id) for r in decontam.clean(d, b).collect()) == ["3"]


def test_odd_and_empty(spark, odd, empty, documents):
    b = spark.createDataFrame([(1, "the same row again and again the same row again and again")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.query(odd, b).collect()) == [6, 7]
    kept = decontam.clean(odd, b)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert decontam.query(empty, b).count() == 0
    assert decontam.query(odd, b.limit(0)).count() == 0
    assert decontam.clean(odd, b.limit(0)).count() == odd.count()


def test_no_plan_has_python(spark, documents, plans):
    b = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    seen = plans(decontam, lambda: decontam.query(documents, b))
    assert len(seen) > 3 and not any(re.search("Python|Arrow|Pandas", p) for p in seen)
