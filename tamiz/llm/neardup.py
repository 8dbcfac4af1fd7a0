"""Groups of documents whose sets of word shingles have a similarity (Jaccard) of 0.8 or more, exactly.

Shingles are hashed as for the fingerprints of operator 6. In any one order of all shingles, two sets of similarity s have
a shingle in common among the first n - ceil(s * n) + 1 of each (n shingles): these are the keys of the candidate join. The
place of a key in both sets bounds what they can share. So does a sketch of BITS bits, one for each class of shingles, that
tells whether the set has an odd number of them: two sets differ in as many shingles at least as their sketches do in bits.
Sets of more shingles than BITS fill such a sketch, so they have a second one, of as many bits as they have shingles or up to
twice that; a pair is compared by the shorter of both, as the longer one's halves together are its sketch of half the bits.
Pairs that these bounds leave, nearly all of a similarity of 0.74 or more, are compared as whole sets: their number, not that
of the candidates, is what whole sets move for. Shingles that are frequent in a sample of the documents come last
in the order, so that phrases which many documents have are seldom keys; the sample decides how many candidates there are,
not which pairs are found.

Equal sets are put together first. Members of a key that more than `bucket` sets share are first compared with one of them;
then only pairs of different groups are made, of which one is outside the key's largest group, and whose sketches allow it.

Defined cases: a text of fewer words than a shingle is one shingle; null, empty and blank texts have none and no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.llm.common import components, first_by_hash, maybe_broadcast, no_shuffles_left, scope, stash, text_key
from tamiz.llm.simhash import groups_of, majority, one_of_each, shingle_digests


#: Bits of every set's sketch, which is held in words of 64.
BITS = 1024


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different shingles of a text as signed longs, in order."""
    return np.unique(np.frombuffer(b"".join(shingle_digests(text, words)), dtype=">i8").astype(np.int64))


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), F.col("text").cast("string").alias("text"))


def parity(s: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The sketch of a set, as signed longs; bits is a power of two, 64 at least."""
    return np.packbits((np.bincount(s & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def wide_parity(s: np.ndarray) -> np.ndarray | None:
    """The second sketch of a set of more shingles than BITS."""
    return parity(s, 1 << (len(s) - 1).bit_length()) if len(s) > BITS else None


def wide_differ(x: Column, y: Column) -> Column:
    """Bits in which second sketches differ, the longer one folded once where it has twice the words of the other; 0 where they
    can't be compared so."""

    def halved(c: Column) -> Column:
        half = F.floor(F.size(c) / 2).cast("int")
        return F.zip_with(F.slice(c, F.lit(1), half), F.slice(c, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    def bits(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda total, n: total + n)

    n, m = F.size(x), F.size(y)
    return F.when(n == m, bits(x, y)).when(n == 2 * m, bits(halved(x), y)).when(m == 2 * n, bits(x, halved(y))).otherwise(F.lit(0))


def slices(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A batch with a column text in parts of so many bytes of it, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def with_sets(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, th, sh, tokens) of rows(doc_id, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, keys, texts = part.columns
                sets = [shingle_set(t.as_py(), words) for t in texts]
                names = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
                yield pa.record_batch([ids, keys, pa.array(names), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "th", "sh", "tokens"])

    return rows.mapInArrow(run, "doc_id long, th long, sh long, tokens array<long>")


def frequent(docs: DataFrame, words: int, sample: int = 20_000, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of three or more of the sampled texts, in order, and their counts there."""
    some = with_sets(first_by_hash(rows_of(docs).dropDuplicates(["th"]), F.xxhash64("th"), sample), words)
    counts = some.select(F.explode("tokens").alias("k")).groupBy("k").agg(F.count("*").alias("n")).where("n > 2")
    with no_shuffles_left(docs.sparkSession):
        got = counts.orderBy(F.col("n").desc(), "k").limit(most).toPandas().sort_values("k")
    return got["k"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def with_keys(docs: DataFrame, words: int, share: tuple[int, int], heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, th, fp, sh, n, keys, bits, wide): the fingerprint by operator 6, the set's name and size, the shingles that it is
    a candidate by, and its sketches. Texts go through once for all."""
    known, counts = heavy
    over, under = share

    def first(s: np.ndarray) -> np.ndarray:
        if not len(s):
            return s
        rank = np.zeros(len(s), dtype=np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            rank = np.where(known[at] == s, counts[at], 0)
        return s[np.lexsort((s, rank))][: len(s) + (-over * len(s)) // under + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, keys, texts = part.columns
                prints = majority([shingle_digests(t.as_py(), 3) for t in texts]).view(np.int64)
                sets = [shingle_set(t.as_py(), words) for t in texts]
                names = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
                sizes = pa.array([len(s) for s in sets], pa.int64())
                lists = [pa.array(x, pa.list_(pa.int64())) for x in ([first(s) for s in sets], [parity(s) for s in sets], [wide_parity(s) for s in sets])]
                yield pa.record_batch([ids, keys, pa.array(prints), pa.array(names), sizes, *lists], names=["doc_id", "th", "fp", "sh", "n", "keys", "bits", "wide"])

    return rows_of(docs).mapInArrow(run, "doc_id long, th long, fp long, sh long, n long, keys array<long>, bits array<long>, wide array<long>")


def near_links(docs: DataFrame, prints: DataFrame, words: int, share: tuple[int, int], bucket: int = 32, rounds: int = 2) -> DataFrame:
    """(a, b): names of sets of prints(doc_id, th, sh, n, keys, bits, wide) that join exactly those that are linked at `share`."""
    over, under = share
    keys = prints.select("sh", "n", F.posexplode("keys").alias("pos", "k"))
    # Most keys are of one set alone: they go before any row moves.
    shared = keys.groupBy("k").agg(F.min("sh").alias("low"), F.max("sh").alias("high")).where("low <> high").select("k")
    shared = stash(shared, "shared")
    # If that takes a shuffle, it is of all keys: what is left is written before it is counted, so that it is one.
    keys = stash(keys.join(maybe_broadcast(shared, shared.count(), 16), "k"), "kept").distinct()
    keys = stash(keys.join(keys.groupBy("k").agg(F.count("*").alias("m")), "k"), "keys")
    names = stash(keys.select("sh").distinct(), "names")
    words64 = [f"b{i}" for i in range(BITS // 64)]
    own = prints.join(maybe_broadcast(names, names.count(), 16), "sh", "left_semi").select("sh", *[F.get("bits", F.lit(i)).alias(b) for i, b in enumerate(words64)])
    sketches = stash(own.groupBy("sh").agg(*[F.min(b).alias(b) for b in words64]), "sketches")  # the same for copies
    held = maybe_broadcast(sketches, sketches.count(), 24 + BITS // 8)
    wide = prints.where("wide is not null").join(maybe_broadcast(names, names.count(), 16), "sh", "left_semi")
    wide = stash(wide.select("sh", "wide").dropDuplicates(["sh"]), "wide")

    def sketched(rows: DataFrame, name: str) -> DataFrame:
        """rows with the sketches of the sets that column `name` names."""
        return rows.join(held.select(F.col("sh").alias(name), *[F.col(b).alias(f"{name}_{b}") for b in words64]), name)

    def allowed(differ: Column, n: Column) -> Column:
        """Whether sets of so many shingles together may differ in so many."""
        return (over + under) * differ <= (under - over) * n

    def near(n: Column) -> Column:
        """Whether sketches of a and b allow that so many shingles of both together make similar enough sets."""
        return allowed(sum((F.bit_count(F.col(f"a_{b}").bitwiseXOR(F.col(f"b_{b}"))) for b in words64), F.lit(0)), n)

    def may(n: Column, pos: Column, n2: Column, pos2: Column) -> Column:
        """Whether sets whose first common shingle has these places can be similar enough."""
        return (over + under) * (1 + F.least(n - pos, n2 - pos2) - 1) >= over * (n + n2)

    def met(left: DataFrame, right: DataFrame, extra: Column | None = None, sketch: bool = False) -> DataFrame:
        """(a, b, n) of sets that meet under a key, with their sizes together."""
        both = left.select("k", F.col("sh").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), *[F.col(c).alias("ca") for c in ("comp",) if c in left.columns])
        other = right.select("k", F.col("sh").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), *[F.col(c).alias("cb") for c in ("comp",) if c in right.columns])
        rule = may(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb")) & (F.col("a") != F.col("b"))
        rule = rule if extra is None else rule & extra
        if sketch:
            both, other, rule = sketched(both, "a"), sketched(other, "b"), rule & near(F.col("na") + F.col("nb"))
        pairs = both.join(other, (both["k"] == other["k"]) & rule)
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("na") + F.col("nb")).alias("n")).distinct()

    def alike(pairs: DataFrame) -> DataFrame:
        """The pairs whose sets are similar enough."""
        pairs = stash(sketched(sketched(stash(pairs, "met"), "a"), "b").where(near(F.col("n"))).select("a", "b", "n"), "close")
        x, y = (wide.select(F.col("sh").alias(s), F.col("wide").alias(w)) for s, w in (("a", "x"), ("b", "y")))
        both = pairs.join(x, "a", "left").join(y, "b", "left")
        pairs = stash(both.where(F.col("x").isNull() | F.col("y").isNull() | allowed(wide_differ(F.col("x"), F.col("y")), F.col("n"))).select("a", "b"), "pairs")
        names = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).distinct()
        at = prints.join(names, prints["sh"] == names["s"]).groupBy("sh").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("w"))
        at = stash(at.select(F.col("w.doc_id").alias("w_id"), F.col("w.th").alias("w_th")), "heads")
        rows = rows_of(docs)
        rows = rows.join(maybe_broadcast(at, at.count()), rows["doc_id"].eqNullSafe(at["w_id"]) & (rows["th"] == at["w_th"])).select("doc_id", "th", "text")
        sets = stash(with_sets(rows, words).dropDuplicates(["sh"]).select("sh", "tokens"), "sets")
        both = pairs.join(sets.select(F.col("sh").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("sh").alias("b"), F.col("tokens").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return stash(both.where((over + under) * common >= over * (F.size("x") + F.size("y"))).select("a", "b"), "alike")

    many = keys.where(F.col("m") > bucket)
    found = None
    for k in range(rounds):
        reps = stash(many.groupBy("k").agg(F.min(F.struct(F.xxhash64("sh", F.lit(k)).alias("o"), "sh", "n", "pos")).alias("r")).select("k", "r.sh", "r.n", "r.pos"), "reps")
        count = reps.count()
        if not count:
            break
        new = alike(met(many, maybe_broadcast(reps, count)))
        found = new if found is None else found.unionByName(new)
    if found is None:
        return alike(met(keys, keys, F.col("a") < F.col("b")))
    roots = components(found)
    named = keys.join(maybe_broadcast(roots, roots.count()), keys["sh"] == roots["node"], "left").select("k", "sh", "n", "pos", "m", F.coalesce("root", "sh").alias("comp"))
    named = stash(named, "named")
    few, many = named.where(F.col("m") <= bucket), named.where(F.col("m") > bucket)
    pairs = met(few, few, (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")))
    main = many.groupBy("k", "comp").agg(F.count("*").alias("c")).groupBy("k").agg(F.max(F.struct("c", "comp")).alias("x")).select("k", F.col("x.comp").alias("main"))
    main = stash(main, "main")
    minor = many.join(maybe_broadcast(main, main.count()), "k").where("comp <> main").select("k", "sh", "n", "pos", "comp")
    pairs = pairs.unionByName(met(minor, many, F.col("ca") != F.col("cb"), sketch=True))
    return found.unionByName(alike(pairs.distinct()))


def dedup(docs: DataFrame, words: int = 5, share: tuple[int, int] = (4, 5), sample: int = 20_000, bucket: int = 32) -> DataFrame:
    """docs with one document of each group: of those within two bits, by operator 6, and those whose shingles are similar."""
    with scope(docs.sparkSession):
        return one_of_each(docs, grouped(docs, words, share, sample, bucket))


def grouped(docs: DataFrame, words: int, share: tuple[int, int], sample: int, bucket: int) -> DataFrame:
    """(doc_id, th, grp) of every document."""
    prints = stash(with_keys(docs, words, share, frequent(docs, words, sample)), "prints")
    groups = groups_of(prints.select("doc_id", "th", "fp"))
    groups = stash(groups.select("doc_id", "th", F.xxhash64("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))).alias("c")), "groups")
    roots = stash(components(near_links(docs, prints, words, share, bucket)), "roots")
    linked = prints.join(maybe_broadcast(roots, roots.count()), prints["sh"] == roots["node"])
    linked = stash(linked.select(F.col("doc_id").alias("l_id"), F.col("th").alias("l_th"), "root").distinct(), "linked")
    both = groups.join(maybe_broadcast(linked, linked.count()), groups["doc_id"].eqNullSafe(linked["l_id"]) & (groups["th"] == linked["l_th"]))
    merged = stash(components(both.select(F.col("c").alias("a"), F.xxhash64("root", F.lit(1)).alias("b"))), "merged")
    named = groups.join(maybe_broadcast(merged, merged.count()), groups["c"] == merged["node"], "left")
    return named.select("doc_id", "th", F.coalesce("root", "c").alias("grp"))
