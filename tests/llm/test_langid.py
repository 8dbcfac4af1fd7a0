import zlib

from tamiz.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.query(docs).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_predictions_read_text_alone(documents):
    from pyspark.sql import functions as F

    model = langid.train(documents.where(~langid.held_out()))
    a = {r.doc_id: r.lang_pred for r in langid.predict(documents, model).collect()}
    b = {r.doc_id: r.lang_pred for r in langid.predict(documents.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")), model).collect()}
    assert a == b


def test_families_and_duels():
    import numpy as np

    texts = {"en": "the house of the", "de": "das haus und der", "fr": "la maison de le", "es": "la casa del el", "xx": "zzz qqq zzz"}
    x = np.array([langid.features(t) for t in texts.values() for _ in range(5)])
    model = langid.Model(x, [k for k in texts for _ in range(5)])
    assert model.families == ["=xx", "germanic", "romance"] and set(model.duels) == {("de", "en"), ("es", "fr")}
    assert all(model.predict(langid.features(t))[0] == k for k, t in texts.items())


def test_odd_and_empty(odd, empty, documents):
    rows = {str(r.doc_id): r for r in langid.query(documents.select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang"))).collect() if r.doc_id is None or r.doc_id < 12}
    assert rows["None"].held_out is False
    alone = langid.query(odd).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in alone if r.doc_id in (1, 2, 3, 9)} == dict.fromkeys((1, 2, 3, 9), ("und", 0.0))
    kept = langid.accepted(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert langid.query(empty).count() == langid.accepted(empty).count() == 0


def test_only_letters_count(spark):
    model = langid.train(spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([("the house of the", "en"), ("la casa del el", "es")] * 5)], "doc_id long, text string, lang string"))
    df = spark.createDataFrame(enumerate(["½ ²", "Ⅷ 12", "½a", "ª", "the house½"]), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert [got[i].lang_pred == langid.UND for i in range(5)] == [True, True, False, False, False]
    assert [got[i].letters for i in range(5)] == [False, False, True, True, True] and got[0].score == 0


def test_the_stage_rejects_by_score_and_keeps_all_if_nothing_was_learned(spark, documents, make):
    low = {(r.doc_id, r.score < 0.95) for r in langid.query(documents).collect()}
    kept = {r.doc_id for r in langid.accepted(documents, 0.95).collect()}
    assert kept == {d for d, x in low if not x} and 0 < len(kept) < len(low)
    bare = make([(i, f"plain english words number {i}") for i in range(6)] + [(9, "...")], lang=None)
    assert {r.doc_id for r in langid.accepted(bare).collect()} == set(range(6))
