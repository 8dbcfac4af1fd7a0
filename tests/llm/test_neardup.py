import random
import time

import pytest
from test_simhash import brute as groups

from tamiz.llm import common, neardup


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows):
    """Ids that stay: the least of each group over both kinds of links, by comparing all pairs."""
    sets, own = [shingles(t) for _, t in rows], list(range(len(rows)))
    first = [c for _, _, c in sorted(groups(rows), key=lambda x: int(x[0]))]

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if first[i] == first[j] or (sets[i] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)):
                a, b = sorted((find(i), find(j)))
                own[b] = a
    return {rows[find(i)][0] for i in range(len(rows))}


def texts(seed):
    """Families of near copies around 0.8, a phrase that many have, short texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    phrase, out = [word() for _ in range(30)], []
    for _ in range(8):
        base = [word() for _ in range(rnd.choice([6, 12, 60, 150]))] + (phrase if rnd.random() < 0.6 else [])
        for _ in range(12):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 30))):
                copy[rnd.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    out += [" ".join(phrase), "", "one two", "one two"]
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("bucket", [32, 2])
def test_matches_brute_force(make, bucket):
    rows = texts(bucket)
    want = brute(rows)
    assert len(want) < len({c for _, _, c in groups(rows)})  # two bits alone leave more
    assert {r.doc_id for r in neardup.dedup(make(rows), bucket=bucket).collect()} == want


def test_odd_and_empty(odd, empty):
    assert neardup.dedup(odd).columns == odd.columns
    assert neardup.dedup(empty).count() == 0


def long_texts(seed):
    """Families of long near copies on both sides of 0.8, and of 2,048 and 4,096 shingles."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    out = []
    for size in (1030, 2040, 2060, 4090):
        base = [word() for _ in range(size)]
        for part in (0, 0.01, 0.02, 0.024, 0.05, 0.06):
            copy = base + [word() for _ in range(rnd.randint(0, 30))]
            for at in rnd.sample(range(size), int(part * size)):
                copy[at] = word()
            out.append(" ".join(copy))
    return list(enumerate(out))


@pytest.mark.parametrize("bucket", [32, 2])
def test_long_texts_move_whole_only_where_they_may_be_linked(make, monkeypatch, bucket):
    rows, seen, real = long_texts(3), [], neardup.stash

    def noted(df, name, **kw):
        out = real(df, name, **kw)
        seen.extend((r.a, r.b) for r in (out.collect() if name == "pairs" else []))
        return out

    monkeypatch.setattr(neardup, "stash", noted)
    assert {r.doc_id for r in neardup.dedup(make(rows), bucket=bucket).collect()} == brute(rows)
    sets = {r.sh: set(r.tokens) for r in neardup.with_sets(neardup.rows_of(make(rows)), 5).collect()}
    assert seen and all(len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) for a, b in seen)


def test_a_stashed_table_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for n in disk.getAllFiles().mkString("\n").split("\n") if "shuffle" in n}
    before, setting = files(), spark.conf.get(common.CLEANUP, None)
    out = common.stash(spark.range(100_000).repartition(7, "id"), "kept")
    for _ in range(50):  # they are removed in the background
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 100_000 and spark.conf.get(common.CLEANUP, None) == setting
