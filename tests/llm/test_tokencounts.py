from collections import Counter

from tamiz.llm import tokencounts as tc
from tamiz.sources.scratch import scratch


def totals(rows):
    return {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in rows.collect()}


def brute(docs):
    encode = tc.encoding().encode_ordinary
    out = Counter()
    for r in docs.collect():
        for version, n in ((tc.WORDS, len((r.text or "").encode().split())), (tc.BPE, len(encode(r.text or "")))):
            out[r.source, r.lang, version, 0] += 1
            out[r.source, r.lang, version, 1] += n
    return {k[:3]: (v, out[*k[:3], 1]) for k, v in out.items() if k[3] == 0}


def test_totals_are_those_of_a_recount(spark, documents):
    assert totals(tc.query(documents, scratch(spark, "rollup"))) == brute(documents)


def test_odd_and_empty(spark, odd, empty):
    assert totals(tc.query(odd, scratch(spark, "rollup"))) == brute(odd)
    assert tc.query(empty, scratch(spark, "rollup")).count() == 0


def test_long_texts_are_counted_as_a_whole(spark):
    text = "The quick's fox, 123 ünï  code\n " * 8000
    df = spark.createDataFrame([(1, text, "a", "en")], "doc_id long, text string, source string, lang string")
    assert tc.token_counts(df).first().bpe == len(tc.encoding().encode_ordinary(text))


def test_batches_count_once(spark):
    rows = lambda *x: spark.createDataFrame(x, "source string, lang string, words long, bpe long")
    r = tc.Rollup(spark, scratch(spark, "rollup"))
    assert totals(r.totals()) == {}
    one, two = rows(("a", "en", 5, 7), ("a", None, 1, 1)), rows(("a", "en", 2, 3))
    assert r.commit("1", tc.inserts(one)) and not r.commit("1", tc.inserts(one))
    assert r.commit("2", tc.revisions(rows(("a", "en", 5, 7)), two))
    want = {("a", "en", tc.WORDS): (1, 2), ("a", "en", tc.BPE): (1, 3), ("a", None, tc.WORDS): (1, 1), ("a", None, tc.BPE): (1, 1)}
    assert totals(r.totals()) == want
    assert r.compact() == 1
    assert totals(r.totals()) == want and r.batches() == {"1", "2"} and not r.commit("2", tc.inserts(one))
    assert r.commit("3", tc.deletes(two)) and ("a", "en", tc.BPE) not in totals(r.totals())
    left = totals(r.totals())
    assert r.compact() == 2 and totals(r.totals()) == left and not r.commit("3", tc.deletes(two))
    assert r.commit("4", tc.inserts(two)) and totals(r.totals()) == want


def test_of_two_writers_of_a_batch_one_counts(spark, monkeypatch):
    r = tc.Rollup(spark, scratch(spark, "rollup"))
    one = spark.createDataFrame([("a", "en", 5, 7)], "source string, lang string, words long, bpe long")
    first, see, asked = r.commit("1", tc.inserts(one)), r._exists, []

    def late(name):  # the second writer looked before the first was done
        asked.append(name)
        return len(asked) > 1 and see(name)

    monkeypatch.setattr(r, "_exists", late)
    assert first and not r.commit("1", tc.inserts(one))
    assert totals(r.totals()) == {("a", "en", tc.WORDS): (1, 5), ("a", "en", tc.BPE): (1, 7)}


def test_a_batch_without_its_mark_is_not_read_and_comes_again(spark):
    r = tc.Rollup(spark, scratch(spark, "rollup"))
    one = spark.createDataFrame([("a", "en", 5, 7)], "source string, lang string, words long, bpe long")
    r.commit("1", tc.inserts(one))
    r.fs.delete(r._hadoop(f"{r.path}/batch=1/_SUCCESS"), False)
    assert totals(r.totals()) == {} and r.commit("1", tc.inserts(one))
    assert totals(r.totals())["a", "en", tc.WORDS] == (1, 5)
