"""Near-duplicate lines by a segment-partition edit join (operator 5), DataFrame functions only.

Two different lines of `min_chars` or more characters, over all documents, are linked when they are at most `tau`
insertions, deletions and substitutions apart. A line of length l is cut into tau + 1 segments: within tau edits one of
them is left whole, and stands in the other line at one of a few places, which depend on the difference of the lengths.
The segments are index keys (length, segment, content), the substrings at these places are probes. This first pass only
tells, by a count that combines before its shuffle, which lines share a key with another; it makes no pairs.

These lines are cut once more, into `parts` segments, of which all but at most tau are left whole: these together are the
key, for each choice of the edited ones. Pairs of a key whose edited segments differ, and whose sketches allow tau edits,
are candidates. A sketch has a bit for each class of characters, or of neighbouring pairs, that tells whether the line has
an odd number of them; an edit turns two bits of the first and four of the second at most. A band of 2 tau + 1 diagonals
held in the bits of one word decides the candidates' distance. All lines go the same way, whatever number share a key.

Copies are put together first: a class is all places of one line text, however short, and only its key is compared. Its
first place, by doc_id and line number, stands for it. A line is kept if it is the first place of its class and no linked
class begins earlier.

Defined cases: null texts have no lines; lines of white space alone are kept and have no class; lines of fewer than
`min_chars` characters, of which two edits would change a good part, are linked to their copies alone; a null doc_id comes
after all others; repeated rows of a document are one document, whose lines are not copies of each other; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.llm.common import fresh, let, maybe_broadcast, scope, stash, text_key

_LAST = 2**63 - 1


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line_no, line): line_no from 0."""
    cut = F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), cut)


def place(doc_id: Column, line_no: Column) -> Column:
    """doc_id and line number as one number of fixed width, in their order."""
    return (F.coalesce(doc_id, F.lit(_LAST)).cast("decimal(19,0)") * F.lit(2**32).cast("decimal(10,0)") + line_no).cast("decimal(38,0)")


def pieces(text: Column, delta: int, tau: int) -> list[tuple[Column, bool]]:
    """Keys of a string that may be `delta` longer than the one that is indexed, and whether the key is the one under which
    the string itself is indexed. A piece that doesn't fit has no key."""
    parts, size = tau + 1, F.char_length(text)
    length = size - delta  # of the indexed string
    base, short = F.floor(length / parts), F.lit(parts) - length % parts  # the longer segments come last
    out = []
    for i in range(parts):
        start, width = i * base + F.greatest(F.lit(0), F.lit(i) - short) + 1, (base + F.when(F.lit(i) >= short, 1).otherwise(0)).cast("int")
        for shift in range(max(-i, delta - (tau - i)), min(i, delta + (tau - i)) + 1):
            at = (start + shift).cast("int")
            fits = (length > 0) & (at >= 1) & (at + width - 1 <= size)
            out.append((F.when(fits, F.xxhash64(length, F.lit(i), F.substring(text, at, width))), delta == shift == 0))
    return out


def patterns(tau: int, parts: int) -> list[list[dict]]:
    """For each delta from 0 to tau, the ways in which a string of `parts` segments becomes one that is `delta` longer by
    edits within some of them: `id` of these segments, `at` (segment * (2 tau + 1) + shift + tau) where each of the others
    stands in the new string, and `gaps`, the same of those edited ones that keep their length."""
    wide = 2 * tau + 1
    out: list[list[dict]] = [[] for _ in range(tau + 1)]
    edited = [s for n in range(1, tau + 1) for s in combinations(range(parts), n)]
    for number, some in enumerate(edited):
        for grows in product(range(-tau, tau + 1), repeat=len(some)):
            if not 0 <= sum(grows) <= tau or sum(max(1, abs(g)) for g in grows) > tau:
                continue
            by, shift, at, gaps = dict(zip(some, grows, strict=True)), 0, [], [-1] * tau
            for i in range(parts):
                here = i * wide + shift + tau
                if i not in by:
                    at.append(here)
                    continue
                if not by[i]:
                    gaps[some.index(i)] = here
                shift += by[i]
            out[shift].append({"id": number, "at": at, "gaps": gaps, "own": not any(grows)})
    return out


def sketch(line: Column, n: int) -> Column:
    """64 bits, one for each class of substrings of n characters: whether the line has an odd number of them."""
    chars = F.split(line, "")
    bit = lambda *c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(*c), F.lit(64)).cast("int"))
    grams = lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: bit(*[F.get(x, i + j) for j in range(n)]))
    odd = lambda x: F.aggregate(grams(x), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))
    return F.when(F.char_length(line) >= n, let(chars, odd)).otherwise(F.lit(0).cast("long"))


def candidates(lined: DataFrame, tau: int, parts: int = 4) -> DataFrame:
    """(a, b), a < b, of lined(h1, line) that may be within tau edits: each is cut into `parts` segments, and all but at
    most tau of them are left whole, at places that the edited ones' growth decides.

    A key is the whole segments together, for each choice of the edited ones; these must differ in both lines. So a pair
    meets under the one choice that fits it, and lines that only share a part of their text don't meet.
    """
    size, wide = F.char_length("line"), 2 * tau + 1
    rows = lined.select("h1", "line", sketch(F.col("line"), 1).alias("one"), sketch(F.col("line"), 2).alias("two"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(tau))).alias("d")).select("*", size.alias("size"), (size - F.col("d")).alias("length"))
    start = lambda i: (i * F.floor(F.col("length") / parts) + F.greatest(F.lit(0), i - parts + F.col("length") % parts)).cast("int")  # noqa: E731  the longer segments come last

    def segment(x: Column) -> Column:
        i, shift = F.floor(x / wide).cast("int"), (x % wide).cast("int") - tau
        return F.when((start(i) + shift >= 0) & (start(i + 1) + shift <= F.col("size")), F.xxhash64(F.substring(F.col("line"), start(i) + shift + 1, start(i + 1) - start(i)))).otherwise(F.lit(-1))

    rows = rows.select("h1", "d", "length", "one", "two", F.transform(F.sequence(F.lit(0), F.lit(parts * wide - 1)), segment).alias("s"))
    rows = stash(rows, "segments")
    ways, kind = patterns(tau, parts), "array<array<struct<id: int, at: array<int>, gaps: array<int>, own: boolean>>>"

    def keyed(ways: list[list[dict]], name: str) -> DataFrame:
        each = rows.where(F.col("d") < len(ways)).select("h1", "d", "length", "one", "two", "s", F.explode(F.get(F.from_json(F.lit(json.dumps(ways)), kind), F.col("d"))).alias("w"))
        key = F.xxhash64("length", "w.id", F.transform("w.at", lambda x: F.get(F.col("s"), x)))
        return each.select(key.alias("k"), F.col("h1").alias(name), F.col("d").alias(f"d_{name}"), F.col("one").alias(f"one_{name}"), F.col("two").alias(f"two_{name}"), *[F.get(F.col("s"), F.get(F.col("w.gaps"), F.lit(g))).alias(f"{name}{g}") for g in range(tau)])

    index, probes = keyed([[w for w in ways[0] if w["own"]]], "a"), keyed(ways, "b")
    differ = (F.col("a") != F.col("b")) & ((F.col("d_b") > 0) | (F.col("a") < F.col("b")))
    for g in range(tau):
        differ &= F.coalesce(F.col(f"a{g}") != F.col(f"b{g}"), F.lit(True))
    for n, turned in (("one", 2 * tau), ("two", 4 * tau)):
        differ &= F.bit_count(F.col(f"{n}_a").bitwiseXOR(F.col(f"{n}_b"))) <= turned
    pairs = index.join(probes, (index["k"] == probes["k"]) & differ)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def with_distance(pairs: DataFrame, a: str, b: str, tau: int) -> DataFrame:
    """pairs with `edits`: the edit distance of the strings a and b, if it is at most tau; else something larger.

    What both begin and end with is cut off first. Each array is a column of its own, so that it is made once for a row.
    """
    chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    same = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p != q, F.lit(True))), F.lit(True)) - 1
    x, y = F.col("__x"), F.col("__y")
    rows = pairs.withColumn("__x", chars(F.col(a))).withColumn("__y", chars(F.col(b)))
    for _ in range(2):  # from the front, then turned round
        rows = rows.withColumn("__n", F.when(x == y, F.size(x)).otherwise(same(x, y)).cast("int"))
        rows = rows.withColumns({k: F.reverse(F.slice(c, F.col("__n") + 1, F.size(c))) for k, c in (("__x", x), ("__y", y))})
    # The band needs tau characters at least: equal ones in front change nothing.
    front = F.array_repeat(F.lit(""), tau)
    rows = rows.withColumns({"__x": F.concat(front, x), "__y": F.concat(front, y)})
    return rows.withColumn("edits", distance(x, y, tau)).drop("__x", "__y", "__n")


def distance(x: Column, y: Column, tau: int) -> Column:
    """Edit distance of two arrays of at least tau characters, both columns, if it is at most tau; else something larger.

    A column of the band holds rows j - tau to j + tau of column j, the least bit at the top: vp and vn have the rows that
    are one above or below the row over them. The distance is carried down the lowest diagonal to the last row of x,
    then along this row.
    """
    m, n, w = F.size(x), F.size(y), 2 * tau + 1
    full = F.lit((1 << w) - 1)
    def step(s: Column, j: Column) -> Column:  # j from 1
        c = F.get(y, j - 1)
        row = lambda t: j + (t - tau - 1)
        eq = [F.when((row(t) >= 0) & (F.get(x, row(t)) == c), F.lit(1 << t)).otherwise(F.lit(0)) for t in range(w)]
        pm = eq[0]
        for e in eq[1:]:
            pm = pm.bitwiseOR(e)
        inv = lambda v: v.bitwiseXOR(full)
        held = F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), pm.alias("pm"))

        def zero(h: Column) -> Column:
            d0 = (h["pm"].bitwiseAND(h["vp"]) + h["vp"]).bitwiseXOR(h["vp"]).bitwiseOR(h["pm"]).bitwiseOR(h["vn"]).bitwiseAND(full)
            return F.struct(h["vp"].alias("vp"), h["vn"].alias("vn"), h["d"].alias("d"), d0.alias("d0"))

        def across(h: Column) -> Column:
            hp = h["vn"].bitwiseOR(inv(h["d0"].bitwiseOR(h["vp"])))
            hn = h["d0"].bitwiseAND(h["vp"])
            return F.struct(h["d"].alias("d"), h["d0"].alias("d0"), hp.alias("hp"), hn.alias("hn"))

        def down(h: Column) -> Column:
            moved = F.shiftright(h["d0"], 1)
            bit = lambda v, t: F.call_function("shiftright", v, t).bitwiseAND(F.lit(1))
            last = m - j + tau  # the bit of a's last row
            d = h["d"] + F.when(last >= 2 * tau, 1 - bit(h["d0"], F.lit(2 * tau))).otherwise(bit(h["hp"], last) - bit(h["hn"], last))
            vp = h["hn"].bitwiseOR(inv(moved.bitwiseOR(h["hp"])))
            return F.struct(vp.alias("vp"), moved.bitwiseAND(h["hp"]).alias("vn"), d.alias("d"))

        once = F.array(held)
        for f in (zero, across, down):  # each names its values once
            once = F.transform(once, f)
        # Down the diagonal the distance never falls, and along the row by 2 tau at most: from 3 tau on nothing is left to find.
        return F.when(s["d"] > 3 * tau, s).otherwise(once[0])

    start = F.struct(F.lit(((1 << w) - 1) & ~((1 << tau) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(tau).alias("d"))
    return F.when(F.abs(m - n) > tau, F.lit(tau + 1)).otherwise(F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["d"]))


def line_classes(docs: DataFrame, tau: int = 2, min_chars: int = 20, parts: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes (h1, h2, n, at), links (a, b, edits) between the classes' h1, and places (doc_id, th, line_no, h1, h2)."""
    found = lines(docs).where(F.col("line").rlike(r"\S"))
    least, size = max(min_chars, parts, tau + 1), F.char_length("line")
    keys = [F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2")]
    own = [x for d in range(tau + 1) for x in pieces(F.col("keyed"), d, tau)]  # null where the line is shorter
    sig, index = [f"k{i}" for i in range(len(own))], [i for i, (_, indexed) in enumerate(own) if indexed]
    at = place(F.col("doc_id"), F.col("line_no")).alias("at")
    flat = found.withColumn("keyed", F.when(size >= least, F.col("line")))
    flat = flat.select(*keys, at, *[k.alias(s) for s, (k, _) in zip(sig, own, strict=True)])
    with scope(docs.sparkSession):
        return _linked(found, flat, sig, index, keys, at, tau, least, parts)


def _linked(found: DataFrame, flat: DataFrame, sig: list[str], index: list[int], keys: list[Column], at: Column, tau: int, least: int, parts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What line_classes() returns; the tables on the way are removed."""
    spark, size = found.sparkSession, F.char_length("line")
    classes = stash(flat.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("at").alias("at"), *[F.min(s).alias(s) for s in sig]), "classes")

    # A key is shared if one line is indexed under it and another, indexed or not, has it.
    probes = classes.select("h1", F.posexplode(F.array(*sig)).alias("i", "k")).where("k is not null").select("h1", "k", F.col("i").isin(index).alias("own"))
    shared = probes.groupBy("k").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.max("own").alias("own"))
    shared = stash(shared.where("own and low <> high").select("k"), "shared")
    heads = probes.join(maybe_broadcast(shared, shared.count(), 16), "k", "left_semi").select("h1").distinct()
    heads = stash(heads.join(classes.select("h1", "at"), "h1").select(F.col("h1").alias("e1"), F.col("at").alias("e_at")), "heads")
    again = found.where(size >= least).select(F.xxhash64("line").alias("h1"), at, "line")
    some = heads.count()
    lined = again.join(maybe_broadcast(heads, some), (F.col("h1") == F.col("e1")) & (F.col("at") == F.col("e_at")))
    lined = stash(lined.select("h1", "line").distinct().repartition(max(spark.sparkContext.defaultParallelism, some // 5000), "h1"), "lined")

    pairs = stash(candidates(lined, tau, parts), "pairs")
    both = pairs.join(lined.select(F.col("h1").alias("a"), F.col("line").alias("la")), "a").join(lined.select(F.col("h1").alias("b"), F.col("line").alias("lb")), "b")
    # Few bytes, but each pair is work: dealt to as many tasks as there are thousands of pairs, or cores.
    tasks = max(spark.sparkContext.defaultParallelism, pairs.count() // 5000)
    # Written before the filter: the optimizer would put the distance's definition into it, array by array.
    edits = stash(with_distance(both.repartition(tasks, "a", "b"), "la", "lb", tau).select("a", "b", "edits"), "edits", outer=True)
    links = edits.where(F.col("edits") <= tau).distinct()
    places = found.select("doc_id", "th", "line_no", *keys)
    return stash(classes.select("h1", "h2", "n", "at"), "classes", outer=True), links, places


def line_duplicates(docs: DataFrame, tau: int = 2, min_chars: int = 20) -> DataFrame:
    """(doc_id, th, line_no, class_doc, class_line, copies, links, keep) of each line that isn't blank.

    class_doc and class_line are the first place of its text, copies the number of its places, links that of the
    different texts within tau edits.
    """
    classes, links, places = line_classes(docs, tau, min_chars)
    ways = links.select(F.col("a").alias("h"), F.col("b").alias("o")).unionByName(links.select(F.col("b").alias("h"), F.col("a").alias("o")))
    at = classes.select(F.col("h1").alias("o"), F.col("at").alias("o_at"))
    linked = ways.join(at, "o").groupBy("h").agg(F.countDistinct("o").alias("links"), F.min("o_at").alias("first")).withColumnRenamed("h", "h1")
    told = classes.join(linked, "h1", "left").where("n > 1 or links is not null")
    told = stash(told, "told").select(F.col("h1").alias("t1"), F.col("h2").alias("t2"), "n", "at", "links", "first")
    told = maybe_broadcast(told, told.count(), 128)
    rows = places.join(told, (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2")), "left")
    here = place(F.col("doc_id"), F.col("line_no"))
    keep = F.col("at").isNull() | ((here == F.col("at")) & (F.col("first").isNull() | (F.col("first") > here)))
    part = F.floor(F.col("at") / F.lit(2**32).cast("decimal(10,0)"))
    doc = F.when(F.col("at").isNull(), F.col("doc_id")).when(part < _LAST, part.cast("long"))
    line = F.when(F.col("at").isNull(), F.col("line_no")).otherwise((F.col("at") % F.lit(2**32).cast("decimal(10,0)")).cast("int"))
    return rows.select("doc_id", "th", "line_no", doc.alias("class_doc"), line.alias("class_line"), F.coalesce("n", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"), keep.alias("keep"))


def dedup_lines(docs: DataFrame, tau: int = 2, min_chars: int = 20) -> DataFrame:
    """docs whose texts lack the lines that aren't kept; documents of which nothing but white space is left by that go.

    An integer column n_chars follows the text.
    """
    names = [fresh(docs, n) for n in ("lost_id", "lost_th", "lost_lines", "text_now")]
    key, th, gone, new = names
    with scope(docs.sparkSession):
        lost = line_duplicates(docs, tau, min_chars).where(~F.col("keep"))
        lost = lost.groupBy(F.col("doc_id").alias(key), F.col("th").alias(th)).agg(F.collect_set("line_no").alias(gone))  # at most a document's lines
        lost = stash(lost, "lost", outer=True)
    rows, numbers = lost.agg(F.count("*"), F.coalesce(F.sum(F.size(gone)), F.lit(0))).first()
    match = docs["doc_id"].eqNullSafe(lost[key]) & (text_key(docs["text"]) == lost[th])
    both = docs.join(maybe_broadcast(lost, rows, 64 + 4 * numbers // max(1, rows)), match, "left")

    def rest(parts: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone)), lambda i: F.get(parts, i)), "\n")

    text = F.when(F.col(gone).isNull(), docs["text"]).otherwise(let(F.split(docs["text"], "\n"), rest))
    both = both.withColumn(new, text).where(F.col(gone).isNull() | F.col(new).rlike(r"\S"))
    now = {"text": F.col(new)}
    if dict(docs.dtypes).get("n_chars") in ("bigint", "int"):
        now["n_chars"] = F.when(F.col(gone).isNull(), docs["n_chars"]).otherwise(F.char_length(F.col(new)).cast(dict(docs.dtypes)["n_chars"]))
    return both.select(*[now[c].alias(c) if c in now else docs[c] for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    """A row for each line that isn't blank: its class, the class's places and links, and whether it is kept."""
    return line_duplicates(docs).drop("th")
