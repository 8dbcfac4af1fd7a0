from collections import defaultdict

import corpus_pipeline
from test_decontam import brute as leaks
from test_linededup import brute as line_table
from test_mixing import check as check_mix
from test_neardup import brute as near_left

from tamiz.llm import mixing


def test_stages_against_brute_force(spark, documents, sf, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing sources"]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = documents
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before = {r.doc_id: r.text for r in docs.collect()}
        after = {r.doc_id: r.text for r in out.collect()} if "text" in out.columns else None
        if name == "language ID":
            assert after == {d: t for d, t in before.items() if t and any(c.isalpha() for c in t)}
        elif name == "line dedup":
            table = line_table(list(before.items()))
            for d, t in before.items():
                left = [x for n, x in enumerate(t.split("\n")) if table.get((d, n), (0, 0, True))[2]]
                assert after.get(d, "") == "\n".join(left) or (d not in after and not "".join(left).strip())
        elif name == "SimHash near-dedup":
            assert set(after) == near_left(sorted(before.items()))
        elif name == "benchmark decontamination":
            bad = {d for d, _ in leaks(list(before.items()), [(r.item_id, r.text) for r in bench.collect()])}
            assert set(after) == set(before) - bad and bad
        else:
            taken = defaultdict(int)
            for r in mixing.mix(docs).collect():
                taken[r.doc_id] += r.taken
            held = defaultdict(int)
            for r in out.collect():
                held[r.doc_id] += len(r.words.split())
                assert r.words in " ".join(before[r.doc_id].split())
            assert held == {d: n for d, n in taken.items() if n}
            check_mix(docs)
        docs = out


def test_run_and_odd_rows(spark, sf, odd, empty):
    assert corpus_pipeline.run(spark, sf).count() > 100
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert "text" in docs.columns and len(docs.columns) == len(odd.columns)
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()
