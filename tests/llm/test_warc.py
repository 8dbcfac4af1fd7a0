import random
import re

from pyspark.sql import functions as F

from tamiz.llm import warc


def test_query_finds_the_damage(spark, sf):
    from oracle import compare, connect

    assert compare(warc.query(spark.read.parquet(f"{sf}/pages.parquet")), connect(sf), warc.SQL) == ""


def replica(spark, n=400, seed=2, spoil=()):
    rnd = random.Random(seed)
    rows, at = [], {}
    for i in range(n):
        a, size = i % 3, rnd.randint(50, 5000)
        o = at.get(a, 0)
        at[a] = o + size
        if (i, "lost") in spoil:
            continue
        rows.append((a, o, size, f"{i}" + ("!" if (i, "bad") in spoil else "")))
    return spark.createDataFrame(rows, "archive long, offset long, length long, digest string")


def test_audit_finds_each_difference_and_no_other(spark):
    spoil = {(7, "bad"), (100, "lost"), (101, "bad"), (399, "lost")}
    first, second = replica(spark), replica(spark, spoil=spoil)
    places = {r.digest: (r.archive, r.offset) for r in first.collect()}
    got = {(r.archive, r.offset, r.status) for r in warc.audit(first, second, 4096, 4).collect()}
    assert got == {(*places[str(i)], {"bad": "corrupt", "lost": "lost"}[k]) for i, k in spoil}
    back = {(r.archive, r.offset, r.status) for r in warc.audit(second, first, 4096, 4).collect()}
    assert back == {(a, o, {"lost": "added"}.get(s, s)) for a, o, s in got}
    assert warc.audit(first, first, 4096, 4).count() == 0


def test_one_empty_or_shorter_replica(spark):
    first = replica(spark, 60)
    assert warc.audit(first, first.limit(0), 4096, 4).groupBy("status").count().collect()[0]["count"] == 60
    assert warc.audit(first.limit(0), first.limit(0)).count() == 0
    cut = first.where("offset < 4096")
    assert warc.audit(first, cut, 4096, 4).count() == first.count() - cut.count()


def test_records_at_one_place_are_all_kept(spark):
    a = spark.createDataFrame([(1, 0, 5, "x"), (1, 0, 5, "y"), (1, 0, 5, "y")], "archive long, offset long, length long, digest string")
    b = spark.createDataFrame([(1, 0, 5, "y"), (1, 0, 5, "x")], "archive long, offset long, length long, digest string")
    assert [r.status for r in warc.audit(a, b).collect()] == ["lost"]


def test_crowded_ids_and_clashing_columns(spark):
    rows = [(5, f"u{i}", "x" * (i % 7), 1, "d", i) for i in range(9000)] + [(6, "u", "same", 1, "d", 1)] * 30
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, volume int, digest string, offset long")
    got = warc.records(pages).collect()
    assert len(got) == 9030 and {r.volume for r in got} == {0, 1, 2} and len({(r.volume, r.offset) for r in got}) == 9030
    for v in range(3):  # without gaps
        own = sorted((r.offset, r.length) for r in got if r.volume == v)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    told = warc.query(pages).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in told} == {"ok": 9030}


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>é</p>"), (2, "", ""), (None, None, None), (3, "u", "x" * 300_000), (3, "u", "x" * 300_000)], "page_id long, url string, html string")
    rows = warc.records(pages)
    assert rows.count() == 6 and rows.where("archive < 0").count() == 2
    assert {r.page_id: r.status for r in warc.query(pages).collect()} == {1: "ok", 2: "ok", 3: "corrupt"} | {None: "ok"}
    assert warc.query(pages.limit(0)).count() == 0
    want = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: u\r\nContent-Length: 9\r\n\r\n<p>é</p>\r\n\r\n"
    got = pages.where("url = 'u' and page_id is null").select(warc.record(F.col("url"), F.col("html")).alias("b")).first().b
    assert bytes(got) == want.encode()


def test_plan_has_no_python(spark, sf):
    plan = warc.query(spark.read.parquet(f"{sf}/pages.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
