"""Golden examples: measures, normalisers, codes, catalogue rules."""

import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamiz.functions import kernels, phonetic
from tamiz.functions import measures as m
from tamiz.functions import text as tx
from tamiz.operators import edit, hamming, jaccard, vectors
from tamiz.operators import phonetic as ph
from tamiz.plans.search import Algorithm, query_tokens, search, search_batch
from tamiz.sources import catalog as cat


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(*xs):
    return [F.lit(x) for x in xs]


@pytest.mark.parametrize(("a", "b", "bits"), [("hello world", "hello worle", 1), ("SKU-1234", "SKU-1244", 3), ("ab", "abc", None), ("", "", 0), ("ñandú-12345", "ñandú-12345", 0)])
def test_hamming_bits(spark, a, b, bits):
    assert one(spark, m.hamming_bits(*lit(a, b))) == bits


def test_hamming_words(spark):
    assert one(spark, m.hamming_words(m.bitmap([0b11110000, 0b00001111]), m.bitmap([0b11100001, 0b00011110]))) == 4
    assert one(spark, m.hamming_words(m.bitmap([2**64 - 1] * 16), m.zeros(16))) == 1024
    assert one(spark, m.hamming_words(m.zeros(2), m.zeros(3))) is None
    assert one(spark, m.hamming_score(*lit("SKU-1234", "SKU-1244"))) == pytest.approx(1 - 3 / 8)
    assert one(spark, m.hamming_positions(*lit("SKU-1234", "SKU-1244"))) == 1


def test_code_typos_and_attributes(spark):
    rows = spark.createDataFrame([("ABC-1234",), ("ABC-1235",), ("XYZ-9999",)], "sku string")
    assert [r.sku for r in hamming.sku_typos(rows, "ABC-1234").collect()] == ["ABC-1235"]
    maps = spark.createDataFrame([("P1", [0] * 8), ("P2", [1] + [0] * 7), ("P3", [255] * 8), ("P4", [0])], "sku string, attributes array<long>")
    assert [r.sku for r in hamming.attribute_distance(maps, [0] * 8, 2).collect()] == ["P1", "P2"]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("Adidas", "Adiddas", 0.971429), ("Adidas", "Adas", 0.911111), ("Nike", "Adidas", 0.472222), ("Niño", "Nino", 0.866667), ("Café", "Cafe", 0.883333), ("Caterpillar", "Cat", 0.0), ("", "", 1.0), ("", "x", None), ("a" * 65, "a", None)],
)
def test_jaro_winkler(a, b, want):
    got = kernels.jaro_winkler(a, b)
    assert got is None if want is None else got == pytest.approx(want, abs=1e-6)


def test_jaro_winkler_parameters(spark):
    with pytest.raises(ValueError):
        kernels.jaro_winkler_similarity(F.lit("a"), F.lit("b"), 0.3)
    assert one(spark, tx.normalize_sku(F.lit("ABC 123-XYZ\t"))) == "ABC123XYZ"


@pytest.mark.parametrize(("a", "b", "free", "two"), [("ca", "abc", 2, 2), ("abc", "ac", 1, 1), ("hola", "holas", 1, 1), ("a1", "2a", 2, 2), ("a1", "1a", 1, 1), ("1a", "2a", 0, 2), ("producto_12345", "producto_12346", 0, 2), ("", "abc", 3, 3)])
def test_true_damerau(a, b, free, two):
    assert (kernels.true_damerau(list(a), list(b)), kernels.true_damerau(list(a), list(b), 2)) == (free, two)
    assert kernels.true_damerau(list(a), list(b), 2, two) == two and (two == 0 or kernels.true_damerau(list(a), list(b), 2, two - 1) is None)


@settings(max_examples=150, deadline=None)
@given(st.text("abc1", max_size=7), st.text("abc1", max_size=7))
def test_true_damerau_against_the_full_matrix(a, b):
    big = len(a) + len(b)
    d = {(-1, -1): big}
    last = dict.fromkeys(a + b, 0)
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = big, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = big, j
    for i in range(1, len(a) + 1):
        k = 0
        for j in range(1, len(b) + 1):
            x, y = last[b[j - 1]], k
            cost = a[i - 1] != b[j - 1]
            if not cost:
                k = j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[x - 1, y - 1] + (i - x - 1) + 1 + (j - y - 1))
        last[a[i - 1]] = i
    assert kernels.true_damerau(list(a), list(b)) == d[len(a), len(b)] == kernels.true_damerau(list(b), list(a))


@pytest.mark.parametrize(("raw", "want"), [("Válvula", "valvula"), ("España", "espanya"), ("España", "espanya"), ("ño", "nyo"), ("TORNILLO-M10X25", "tornillom10x25"), ("SKF-6205/2RS!", "skf62052rs"), ("Straße", "strasse")])
def test_phonetic_normaliser(spark, raw, want):
    assert one(spark, tx.normalize_phonetic(F.lit(raw))) == want == phonetic.normalized(raw).lower()


CODES = "Caterpillar KTRPYR KTRPLR,Katerpilar KTRPLR KTRPLR,Cayerpilar KYRPLR KYRPLR,Gasket KSKT KSKT,Gasquetes KSKTS KSKTS,Válvula PLPL PLPL,Balvula PLPL PLPL,Llanta YNT LNT,Yanta YNT YNT,Schmidt SXMTT SKMTT,Smith SM0 SMT,Smyth SM0 SMT,Hernandez ARNNTS ARNNTS,Ernandez ARNNTS ARNNTS,Bosch PSX PSK,Vosch PSX PSK,Bosh PX PX,Llamo YM LM,Yamo YM YM,A A A,B P P"


def test_phonetic_codes(spark):
    want = {w: (p, s) for w, p, s in (x.split() for x in CODES.split(","))} | {"": ("", ""), "123": ("", "")}
    df = spark.createDataFrame([(w,) for w in want], "w string").select("w", phonetic.codes(F.col("w")).alias("c"))
    assert {r.w: tuple(r.c) for r in df.collect()} == want
    with pytest.raises(ValueError):
        phonetic.codes(F.lit("a"), 9)


def test_phonetic_variants():
    near = phonetic.variants("KTRPLR", 1)
    assert near["TRPLR"] == near["KTRPLRX"] == near["TKRPLR"] == near["KTRPLA"] == 1 and "KTRPLR" not in near
    assert not any("0" in v for v in near) and phonetic.variants("AB", 2)["BA"] == 1


def names(spark, *rows):
    return cat.from_dataframe(spark.createDataFrame([(i, f"S{i}", n) for i, n in enumerate(rows)], "i long, id string, name string"), "id", "name", order="i")


def test_phonetic_probes(spark):
    c = names(spark, "Caterpillar", "Katerpilar", "Gasket", "Llanta", "Yanta")
    assert [r.name for r in search(c, "Katerpilar", Algorithm.PHONETIC).collect()] == ["Katerpilar", "Caterpillar"]
    got = search(c, "Cayerpilar", Algorithm.PHONETIC).collect()
    assert [(r.name, round(r.score, 1)) for r in got] == [("Caterpillar", 0.7), ("Katerpilar", 0.7)]
    assert ph.key_counts(c.codes).first().asDict() == {"primary_keys": 4, "secondary_keys": 4, "total_records": 5}
    assert search(c, "12", Algorithm.PHONETIC).count() == 0


def test_tokens(spark):
    for text, want in [("Válvula 10", ["Va", "lvula", "10"]), ("tornillo de el El", ["tornillo", "El"]), ("", []), ("él", ["l"])]:
        assert one(spark, tx.word_tokens(F.lit(text))) == want == query_tokens(text)


def test_graphemes(spark):
    assert one(spark, tx.graphemes(F.lit("a👨‍💻é"))) == ["a", "👨‍💻", "é"]
    assert one(spark, tx.preprocess(F.lit("ÉA"))) == ["é", "a"]
    assert one(spark, tx.bigram_shingles(F.lit("aaa"))) == ["aa"] and one(spark, tx.bigram_shingles(F.lit("a"))) == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("xyz"), max_size=6), st.lists(st.sampled_from("xyz"), max_size=6)), min_size=1, max_size=20))
def test_bag_jaccard_against_counters(spark, pairs):
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for r in df.select("a", "b", m.jaccard(F.col("a"), F.col("b")).alias("j"), m.dice(F.array_distinct("a"), F.array_distinct("b")).alias("d")).collect():
        inter = sum((Counter(r.a) & Counter(r.b)).values())
        union = len(r.a) + len(r.b) - inter
        assert r.j == pytest.approx(inter / union if union else 1.0, abs=1e-6)
        x, y = set(r.a), set(r.b)
        assert r.d == pytest.approx(2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0)


SHOP = ["Tornillo Hexagonal", "Tuerca Hexagonal", "Arandela Plana", "Tornillo de Cabeza Plana", "Hexagonal Tornillo"]


def test_hamming_of_any_kind(spark):
    df = spark.createDataFrame([("ab", "ac", bytearray(b"ab"), [1, 2], [1, 3])], "a string, b string, c binary, x array<bigint>, y array<bigint>")
    assert [hamming.distance(df, *p).first().distance for p in (("a", "b"), ("c", "b"), ("x", "y"))] == [1, 1, 1]
    with pytest.raises(TypeError):
        hamming.distance(df, "a", "x")


def test_jaccard_catalogue(spark):
    t = names(spark, *SHOP).tokens
    got = [(r.row_idx, round(r.score, 4)) for r in jaccard.search(t, query_tokens("Hexagonal Tornillo"), 3).collect()]
    assert got == [(0, 1.0), (4, 1.0), (1, 0.3333)]
    assert [(r.i, r.j, r.score) for r in jaccard.duplicates(t, 0.9).collect()] == [(0, 4, 1.0)]
    assert [(r.row_idx, round(r.score, 4)) for r in jaccard.recommend(t, 0, 3).collect()] == [(4, 1.0), (1, 0.3333), (3, 0.25)]
    with pytest.raises(IndexError):
        jaccard.recommend(t, 99, 3)


def test_duplicates_against_all_pairs(spark):
    import random

    rnd = random.Random(2)
    rows = [(i, [rnd.choice("abcdefg") for _ in range(rnd.randint(0, 6))]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_idx long, tokens array<string>")
    for t in (0.3, 0.5, 0.8, 1.0):
        want = set()
        for i, x in rows:
            for j, y in rows:
                inter = sum((Counter(x) & Counter(y)).values())
                union = len(x) + len(y) - inter
                if i < j and (inter / union if union else 1.0) >= t - 1e-9:
                    want.add((i, j))
        assert {(r.i, r.j) for r in jaccard.duplicates(df, t).collect()} == want


def test_long_bags_move_whole_only_where_they_may_be_duplicates(spark, monkeypatch):
    import random

    rnd, rows, seen, real = random.Random(4), [], [], jaccard.stash
    for n in (60, 250, 500, 520, 1000):  # on both sides of a power of two
        base = [str(rnd.randint(0, 3 * n)) for _ in range(n)]
        for part in (0, 0.05, 0.1, 0.11, 0.12, 0.2, 0.25):
            rows.append((len(rows), [str(rnd.randint(0, 3 * n)) if rnd.random() < part else t for t in base] + base[: rnd.randint(0, n // 20)]))

    def noted(df, name):
        out = real(df, name)
        seen.extend((r.a, r.b) for r in (out.collect() if name == "pairs" else []))
        return out

    def ratio(i, j):
        inter = sum((Counter(rows[i][1]) & Counter(rows[j][1])).values())
        return inter / (len(rows[i][1]) + len(rows[j][1]) - inter)

    monkeypatch.setattr(jaccard, "stash", noted)
    monkeypatch.setattr(jaccard._compared, "__defaults__", (60_000,))  # in several parts
    got = {(r.i, r.j): r.score for r in jaccard.duplicates(spark.createDataFrame(rows, "row_idx long, tokens array<string>"), 0.8).collect()}
    want = {(i, j): ratio(i, j) for j in range(len(rows)) for i in range(j) if ratio(i, j) >= 0.8 - 1e-9}
    assert got == pytest.approx(want, abs=1e-6) and 10 < len(want)
    assert seen and all(ratio(i, j) > 0.65 for i, j in seen)


def test_a_kept_table_leaves_no_shuffle_files(spark):
    import time

    from tamiz.sources.scratch import stash

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for n in disk.getAllFiles().mkString("\n").split("\n") if "shuffle" in n}
    before = files()
    out = stash(spark.range(100_000).repartition(7, "id"), "kept")
    for _ in range(50):  # they are removed in the background
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 100_000


def test_minhash_error(spark):
    a, b = [str(i) for i in range(200)], [str(i) for i in range(100, 300)]
    s = m.minhash(F.array(*lit(*a)), 256), m.minhash(F.array(*lit(*b)), 256)
    assert abs(one(spark, m.minhash_estimate(*s)) - 1 / 3) < 4 * math.sqrt(1 / 3 * 2 / 3 / 256)
    assert one(spark, m.minhash_estimate(s[0], s[0])) == 1.0


def test_edit_search_is_the_exact_filter(spark):
    import random

    rnd = random.Random(7)
    rows = [(i, "".join(rnd.choice("ab1é") for _ in range(rnd.randint(0, 9)))) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, name string")
    for q in ("aab1b", "é", "11b1a11a"):
        for t in (0.5, 0.85):
            sim = lambda x: 1 - kernels.true_damerau(list(x), list(q)) / max(len(x), len(q))  # noqa: B023, E731
            want = {i for i, x in rows if sim(x) >= t}
            assert {r.i for r in edit.search(df, q, t).collect()} == want
            batch = edit.search_batch(df, spark.createDataFrame([(0, q)], "q_idx int, q string"), t)
            assert {r.i for r in batch.collect()} == want


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, m.cosine(v(1, 0), v(0, 1))) == 0 and one(spark, m.cosine(v(0, 0), v(0, 1))) == 0
    assert one(spark, m.l2_norm(m.l2_normalize(v(3, 4, 0)))) == pytest.approx(1, abs=1e-6)
    assert one(spark, m.l2_normalize(v(0, 0))) == [0, 0] and one(spark, m.dot(v(1), v(1, 2))) is None
    a, b, c = kernels.mock_vectors(["same", "same", "other"])
    assert float(a @ b) == pytest.approx(1, abs=1e-5) and float(a @ c) == pytest.approx(0.75, abs=0.06) and a.max() <= 0
    rows = spark.createDataFrame([(0, "x", [1.0, 0.0]), (1, "y", [1.0, 0.0]), (2, "z", [0.0, 1.0])], "row_idx long, label string, vec array<float>")
    assert [r.row_idx for r in vectors.linear_search(rows, [1.0, 0.0], 2, True).collect()] == [1, 0]
    with pytest.raises(Exception, match="another length"):
        vectors.linear_search(rows, [1.0], 2, True).collect()
    with pytest.raises(Exception, match="components"):
        cat.vectors(rows, "label", "vec", 3).collect()


def test_vector_index(spark):
    rows = cat.synthetic_vectors(spark, 600, 16, clusters=6, spread=0.1).cache()
    index = vectors.build_index(rows, 12)
    assert index.rows.count() == 600 and len(index.radii) <= 12
    for i in (0, 1, 77):
        q = list(rows.where(f"row_idx = {i}").first().vec)
        want = [r.row_idx for r in vectors.nearest(rows, q, 20).collect()]
        assert [r.row_idx for r in vectors.search_index(index, q, 20).collect()] == want
        near = [r.row_idx for r in vectors.search_index(index, q, 20, probes=3, exact=False).collect()]
        assert len(set(near) & set(want)) >= 18
    few = cat.synthetic_vectors(spark, 3, 4)
    assert vectors.search_index(vectors.build_index(few, 8), [1.0, 0, 0, 0], 5).count() == 3


def test_search_rules(spark):
    rows = [(i, f"C{i:03d}", "red plate", 1) for i in range(60)] + [(60, "C060", "red plate", 0), (61, "C000", "other", 1)]
    c = cat.from_dataframe(spark.createDataFrame(rows, "i long, id string, name string, on int"), "id", "name", active=F.col("on"), order="i")
    for a in (Algorithm.DICE, Algorithm.JACCARD, Algorithm.JARO_WINKLER):
        got = search(c, "red plate", a).collect()
        assert [r.id for r in got] == [f"C{i:03d}" for i in range(50)] and [r["rank"] for r in got] == list(range(1, 51))
        assert search(c, "red plate", a, 100, active_only=False).count() >= 61
    for a in (Algorithm.DAMERAU, Algorithm.PHONETIC, Algorithm.COSINE):
        assert "C060" in [r.id for r in search(c, "red plate", a, 61).collect()]
        assert "C060" not in [r.id for r in search(c, "red plate", a, 61, active_only=True).collect()]
    assert search(c, "  ", Algorithm.HAMMING).count() == 0 and Algorithm.of(42) == Algorithm.HAMMING
    assert search(c, "other", Algorithm.DAMERAU).first().name == "red plate"  # an id's name is that of its first row


@pytest.mark.parametrize("algorithm", list(Algorithm))
def test_batch_is_search_for_each_query(spark, algorithm):
    shop = ["Caterpillar", "Katerpilar", "tornillo", "tornilo largo", "de la", "", "el", "TORNILLO", "ñandú é", "tuerca 10", "tuerca 11", "x"]
    rows = [(i, f"C{i % 9:03d}", n, int(i % 5 != 3)) for i, n in enumerate(shop * 2)]
    c = cat.from_dataframe(spark.createDataFrame(rows, "i long, id string, name string, on int"), "id", "name", active=F.col("on"), order="i")
    asked = ["Cayerpilar", "de la", "tornillo", "C004", "C00", "tuerca 12", "  ", "\u00a0", "katerpilar", "x"]
    got = {}
    for r in search_batch(c, spark.createDataFrame(list(enumerate(asked)), "q_idx int, q string"), algorithm, 7).collect():
        got.setdefault(r.q_idx, {})[r["rank"]] = (r.id, r.name, round(r.score, 9))
    for i, q in enumerate(asked):
        assert got.get(i, {}) == {r["rank"]: (r.id, r.name, round(r.score, 9)) for r in search(c, q, algorithm, 7).collect()}, q


def test_own_encoder_backend_and_metric(spark):
    from dataclasses import replace

    import numpy as np

    from tamiz.functions.backends import Embedding, Encoder

    c = names(spark, "uno", "unidad", "dos", "tres", "doce")
    first = replace(c, encoder=Encoder(lambda s: (s[:1].upper(), s[:2].upper())))
    assert [r.name for r in search(first, "una", Algorithm.PHONETIC).collect()] == ["uno", "unidad"]
    sized = replace(c, backend=Embedding(lambda texts: np.array([[len(t), 0.0] for t in texts])))
    assert search(sized, "abcdef", Algorithm.COSINE, 1).first().name == "unidad"
    near = edit.search(c.rows, "dot", 0.6, metric=lambda a, b: sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b)))
    assert {r.name for r in near.collect()} == {"dos"}


def test_values_are_made_once_for_a_row(spark):
    plan = spark.range(3).select(F.col("id").cast("string").alias("name")).select(tx.bigram_shingles(F.col("name")).alias("g"), m.hamming_bits(F.col("name"), F.col("name")).alias("h"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("\\X") == 1 and text.count("hex(") == 2


def test_jaro_winkler_conditions_lose_nothing(spark):
    import random

    from tamiz.plans.search import _may_wink

    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice("abcé\r") for _ in range(rnd.randint(0, 9))), "".join(rnd.choice("cdeé") for _ in range(rnd.randint(1, 14)))) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, a string, b string")
    kept = {r.i for r in df.where(_may_wink(F.col("a"), F.col("b"))).collect()}
    assert all(i in kept for i, a, b in rows if kernels.jaro_winkler(a, b)) and len(kept) < 400


def test_csv(spark, tmp_path):
    f = tmp_path / "c.csv"
    f.write_text('activo,id_codigo,descripcion_articulo,descripcion_larga_art,unidad_medida,ultimo_precio\n1,A,"uno, ""dos""\nlinea",larga,,1.5\nx,B,b,b,b,b\n0,C,c,,u,\n1,D\n1,E,e,e,u,2,more\n1,F,f,f,u,3\n')
    got = [tuple(r) for r in cat.load_csv(spark, str(f)).rows.orderBy("row_idx").select("id", "name", "long_name", "active").collect()]
    assert got == [("A", 'uno, "dos"\nlinea', "larga", 1), ("C", "c", "", 0), ("F", "f", "f", 1)]
    assert cat.load_csv(spark, str(tmp_path / "none.csv")) is None
    both = cat.load_csv(spark, str(f)).insert(names(spark, "x"))
    assert both.count() == len(got) + 1 and not both.is_empty()


def test_stream_of_queries(spark, tmp_path):
    from tamiz.streaming.queries import answer

    c = names(spark, *SHOP)
    spark.createDataFrame([(0, "Hexagonal Tornillo"), (1, "Plana")], "q_idx int, q string").write.json(str(tmp_path / "in"))
    got = []
    q = answer(spark.readStream.schema("q_idx int, q string").json(str(tmp_path / "in")), c, Algorithm.JACCARD, lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {(r.q_idx, r.name) for r in got if r["rank"] == 1} == {(0, "Tornillo Hexagonal"), (1, "Arandela Plana")}


def test_generators(spark):
    rows = [tuple(r) for r in cat.synthetic(spark, 200).rows.collect()]
    assert rows == [tuple(r) for r in cat.synthetic(spark, 200).rows.collect()] and len({r[1] for r in rows}) == 200
    plain = [tuple(r)[2] for r in cat.synthetic(spark, 200, 0.0).rows.collect()]
    slips = [kernels.true_damerau(list(a), list(b)) for a, b in zip(plain, [r[2] for r in rows], strict=True)]
    assert max(slips) == 1 and 50 < sum(slips) < 150
    heard = cat.synthetic_sounds(spark, 50).where("plain <> heard").collect()
    assert len(heard) > 10
    v = cat.synthetic_vectors(spark, 40, 8).collect()
    assert len({r.label for r in v}) == 8 and all(abs(sum(x * x for x in r.vec) - 1) < 1e-5 for r in v)


def test_latency_percentiles(spark):
    from tamiz.plans.latency import percentiles

    got = percentiles([lambda: spark.range(3)] * 5)
    assert got["runs"] == 5 and 0 < got["p50_ms"] <= got["p95_ms"]


def test_all_pairs_for_a_threshold_of_zero(spark):
    df = spark.createDataFrame([(0, ["a"]), (1, ["b"]), (2, []), (3, ["a", "b"])], "row_idx long, tokens array<string>")
    got = {(r.i, r.j): round(r.score, 3) for r in jaccard.duplicates(df, 0.0).collect()}
    assert got == {(0, 1): 0, (0, 2): 0, (0, 3): 0.5, (1, 2): 0, (1, 3): 0.5, (2, 3): 0}


def test_entry_without_the_training_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copytree(root / "tamiz", tmp_path / "tamiz", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    ask = "import __spark_entry__ as e; q = e.queries(); assert 'search_jaccard' in q and 'op6_simhash' not in q and set(e.oracle_sql()) <= set(q)"
    out = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    if (root / "tamiz/llm").exists():  # nor does one that lacks what they need fail
        shutil.copytree(root / "tamiz/llm", tmp_path / "tamiz/llm")
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
        (tmp_path / "tiktoken.py").write_text("raise ImportError('not here')")
        out = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True)
        assert out.returncode == 0, out.stderr
