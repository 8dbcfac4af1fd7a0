import random
import re

from pyspark.sql import functions as F

from tamiz.llm import linededup


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def brute(rows, tau=2, least=20):
    """(doc, line) -> (class, links, keep) of lines of rows(doc_id, text), ids unique."""
    found = [(d, n, x) for d, t in rows if t is not None for n, x in enumerate(t.split("\n")) if re.search(r"(?a:\S)", x)]
    first, out = {}, {}
    for d, n, x in sorted(found):
        first.setdefault(x, (d, n))
    linked = {x: [y for y in first if x != y and min(len(x), len(y)) >= least and abs(len(x) - len(y)) <= tau and lev(x, y) <= tau] for x in first}
    for d, n, x in found:
        keep = first[x] == (d, n) and all(first[y] > (d, n) for y in linked[x])
        out[d, n] = (first[x], len(linked[x]), keep)
    return out


def ours(docs):
    return {(r.doc_id, r.line_no): ((r.class_doc, r.class_line), r.links, r.keep) for r in linededup.query(docs).collect()}


def texts(seed=1):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(18, 60))) for _ in range(25)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            x = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                k, i = rnd.randint(0, 2), rnd.randrange(len(x))
                x[i : i + (k > 0)] = [] if k == 1 else ["z"]
            lines.append("".join(x))
        rows.append((d, "\n".join(lines)))
    return rows


def test_matches_brute_force(spark, make):
    rows = texts()
    assert ours(make(rows)) == brute(rows)
    assert any(links for _, links, _ in brute(rows).values())


def test_bit_parallel_distance(spark):
    rnd = random.Random(4)
    pairs = []
    for _ in range(400):
        a = [rnd.choice("abc😀") for _ in range(rnd.randint(0, 25))]
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            k, i = rnd.randint(0, 2), rnd.randint(0, len(b))
            b[i : i + (k > 0)] = [] if k == 1 else ["d"]
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for tau in (1, 2, 3):
        for r in linededup.with_distance(df, "a", "b", tau).collect():
            d = lev(r.a, r.b)
            assert r.edits == d if d <= tau else r.edits > tau


def test_dedup_takes_later_lines_out(make):
    docs = make([(1, "this line stands in both of them\nown line of the first one"), (2, "this line stands in both of then\nshort\nanother line of its own"), (3, "this line stands in both of them"), (4, ""), (5, None)])
    got = {r.doc_id: (r.text, r.n_chars) for r in linededup.dedup_lines(docs).collect()}
    assert got[1][0].count("\n") == 1 and got[2] == ("short\nanother line of its own", 29) and 3 not in got and got[4][0] == "" and got[5][0] is None


def test_odd_and_empty(odd, empty):
    got = {(str(r.doc_id), r.line_no): r.keep for r in linededup.query(odd).collect()}
    assert got["10", 0] and not got["10", 1] and not got["7", 0] and got["6", 0] and got["None", 0]
    out = linededup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count() - 1
    assert linededup.query(empty).count() == linededup.dedup_lines(empty).count() == 0


def test_no_plan_has_python(documents, plans):
    seen = plans(linededup, lambda: linededup.query(documents))
    assert len(seen) > 3 and not any(re.search("Python|Arrow|Pandas", p) for p in seen)


def test_short_lines_are_linked_to_their_copies_alone(make):
    rows = [(1, "Yes.\nNo.\n\n  "), (2, "Yes.\nYes!\n"), (3, "Yes.")]
    assert ours(make(rows)) == brute(rows)
    assert {r.doc_id: r.text for r in linededup.dedup_lines(make(rows)).collect()} == {1: "Yes.\nNo.\n\n  ", 2: "Yes!\n"}


def test_many_variants_of_a_line(spark, make):
    """Many lines share each key, and more segments find the same links."""
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(60)) for _ in range(3)]
    rows = []
    for d in range(150):
        x = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 5)):
            k, i = rnd.randint(0, 2), rnd.randrange(len(x))
            x[i : i + (k > 0)] = [] if k == 1 else [rnd.choice("xyz")]
        rows.append((d, "".join(x)))
    docs = make(rows)

    def links(parts):
        return {(r.a, r.b, r.edits) for r in linededup.line_classes(docs, parts=parts)[1].collect()}

    assert links(4) == links(7)
    assert ours(docs) == brute(rows)


def test_sketches_turn_few_bits(spark):
    rnd = random.Random(6)
    pairs = []
    for _ in range(300):
        a = [rnd.choice("abcdefghijklmno é") for _ in range(rnd.randint(2, 40))]
        b = list(a)
        for _ in range(2):
            k, i = rnd.randint(0, 2), rnd.randrange(len(b) + 1)
            b[i : i + (k > 0)] = [] if k == 1 else [rnd.choice("pqrstuvwxyz")]
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    bits = [F.bit_count(linededup.sketch(F.col("a"), n).bitwiseXOR(linededup.sketch(F.col("b"), n))).alias(f"n{n}") for n in (1, 2)]
    got = df.select(*bits).collect()
    assert max(r.n1 for r in got) == 4 and 6 <= max(r.n2 for r in got) <= 8


def test_clashing_column_names(spark):
    docs = spark.createDataFrame([(1, "the same line is in both texts\nfirst", 9, [1], "a"), (2, "the same line is in both texts\nsecond", 8, [2], "b")], "doc_id long, text string, lost_id int, LOST_LINES array<int>, text_now string")
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns and {tuple(r)[:3] for r in out.collect()} == {(1, "the same line is in both texts\nfirst", 9), (2, "second", 8)}
