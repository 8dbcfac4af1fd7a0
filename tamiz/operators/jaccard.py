"""Token-bag search, recommendations, duplicate detection and MinHash."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions import measures as m
from tamiz.sources.scratch import stash, writing


def search(tokens: DataFrame, query_tokens: list[str], k: int) -> DataFrame:
    """The k rows of tokens(row_idx, name, tokens) most like the query, zero scores too, ties in catalogue order."""
    q = F.array(*[F.lit(t) for t in query_tokens]).cast("array<string>")
    return tokens.select("row_idx", "name", m.jaccard(F.col("tokens"), q).alias("score")).orderBy(F.desc("score"), "row_idx").limit(k)


def recommend(tokens: DataFrame, row_idx: int, k: int) -> DataFrame:
    """The k rows most like a row, without itself. An index that isn't there is an error."""
    own = tokens.where(F.col("row_idx") == row_idx).select("tokens").first()
    if own is None:
        raise IndexError(f"no row {row_idx}")
    return search(tokens.where(F.col("row_idx") != row_idx), list(own["tokens"]), k)


def keyed(tokens: DataFrame) -> DataFrame:
    """(row_idx, tokens, h1, h2) of tokens(row_idx, tokens): sorted bags, with a key of 128 bits that equal ones share."""
    rows = tokens.select("row_idx", F.array_sort("tokens").alias("tokens"))
    return stash(rows.select("row_idx", "tokens", F.xxhash64("tokens").alias("h1"), F.xxhash64("tokens", F.lit(1)).alias("h2")), "bags")


def membership(rows: DataFrame) -> DataFrame:
    """(row_idx, bag) of keyed(): a bag is named after its first row."""
    first = rows.groupBy("h1", "h2").agg(F.min("row_idx").alias("bag"))
    return rows.select("row_idx", "h1", "h2").join(first, ["h1", "h2"]).select("row_idx", "bag")


def bags(tokens: DataFrame) -> DataFrame:
    """(bag, tokens, n, first, rows): the different bags of tokens(row_idx, tokens), each with its first row and row count."""
    return _bags(keyed(tokens))


def _bags(rows: DataFrame) -> DataFrame:
    first = rows.groupBy("h1", "h2").agg(F.min("row_idx").alias("first"), F.count("*").alias("rows"))
    own = rows.join(first.drop("h1", "h2"), F.col("row_idx") == F.col("first"))
    return own.select(F.col("first").alias("bag"), "tokens", F.size("tokens").alias("n"), "first", "rows")


def _numbered(h: np.ndarray) -> np.ndarray:
    """A bag's tokens as a set, in order: each is hashed with its number among equal ones. h: hashes of tokens, in order."""
    at = np.arange(len(h))
    i = at - np.maximum.accumulate(np.where(np.r_[True, h[1:] != h[:-1]][: len(h)], at, 0))
    x = h.view(np.uint64) + i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.sort((x ^ (x >> np.uint64(31))).view(np.int64))


def _sketch(s: np.ndarray) -> np.ndarray:
    """A bit for each class of a set's hashes, set if it has an odd number of them: as many as the set has, or up to twice that."""
    bits = max(64, 1 << (max(len(s), 1) - 1).bit_length())
    return np.packbits((np.bincount(s & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [_numbered(np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.int64)) for x in batch.column("h")]


def _sets(own: DataFrame) -> DataFrame:
    """(bag, n, ts) of own(bag, n, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("bag"), batch.column("n"), pa.array(_arrays(batch), pa.list_(pa.int64()))], names=["bag", "n", "ts"])

    return own.mapInArrow(run, f"bag {own.schema['bag'].dataType.simpleString()}, n int, ts array<bigint>")


def _frequent(own: DataFrame, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """The `most` tokens that most bags of own(bag, n, h) have, in order, and how many. They come last in the order of tokens,
    all others first: this decides how many candidates there are, not which pairs are found."""
    counts = _sets(own).select(F.explode("ts").alias("t")).groupBy("t").agg(F.count("*").alias("df")).where("df > 2")
    with writing(own.sparkSession):
        got = counts.orderBy(F.desc("df"), "t").limit(most).toPandas().sort_values("t")  # two numbers for each
    return got["t"].to_numpy(np.int64), got["df"].to_numpy(np.int64)


def _marked(own: DataFrame, threshold: float) -> DataFrame:
    """(bag, n, keys, sketch) of own(bag, n, h): keys are the first tokens, by which a bag is a candidate."""
    known, counts = _frequent(own)

    def first(s: np.ndarray) -> np.ndarray:
        df = np.zeros(len(s), dtype=np.int64)
        if len(known) and len(s):
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            df = np.where(known[at] == s, counts[at], 0)
        return s[np.lexsort((s, df))][: len(s) - math.ceil(len(s) * threshold - 1e-9) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _arrays(batch)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in ([first(s) for s in sets], [_sketch(s) for s in sets])]
            yield pa.record_batch([batch.column("bag"), batch.column("n"), *lists], names=["bag", "n", "keys", "sketch"])

    return own.mapInArrow(run, f"bag {own.schema['bag'].dataType.simpleString()}, n int, keys array<bigint>, sketch array<bigint>")


def _differ(x: Column, y: Column) -> Column:
    """Bits in which sketches differ, the longer one folded once where it has twice the words of the other; 0 where they can't
    be compared so."""

    def halved(c: Column) -> Column:
        half = F.floor(F.size(c) / 2).cast("int")
        return F.zip_with(F.slice(c, F.lit(1), half), F.slice(c, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    def bits(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda total, n: total + n)

    n, m = F.size(x), F.size(y)
    return F.when(n == m, bits(x, y)).when(n == 2 * m, bits(halved(x), y)).when(m == 2 * n, bits(x, halved(y))).otherwise(F.lit(0))


def _small(df: DataFrame) -> DataFrame:
    """A table of row numbers, broadcast if it has 32 MB at most."""
    return F.broadcast(df) if df.count() * 32 <= 32_000_000 else df


def _compared(pairs: DataFrame, values: DataFrame, name: str, then: Callable[[DataFrame], DataFrame], most: int = 32_000_000) -> DataFrame:
    """then(a, b, na, va, nb, vb) of pairs(a, b), with values(bag, n, v) of both, written. Values move once for a part of the
    bags, never once for a pair: a part is what is broadcast at a time, of `most` bytes or so."""
    size = values.agg(F.sum(F.size("v") * F.lit(8).cast("long") + 48)).first()[0] or 0
    parts, out = max(1, math.ceil(size / most)), None
    of = lambda c, k: F.pmod(F.xxhash64(c), F.lit(parts)) == k
    y = values.select(F.col("bag").alias("b"), F.col("n").alias("nb"), F.col("v").alias("vb"))
    for k in range(parts):
        x = values.where(of("bag", k)).select(F.col("bag").alias("a"), F.col("n").alias("na"), F.col("v").alias("va"))
        got = stash(then(pairs.where(of("a", k)).join(y, "b").join(F.broadcast(x), "a")), name)
        out = got if out is None else out.unionByName(got)
    return out


def bag_links(tokens: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of the different bags, by first row, a < b, whose similarity is `threshold` or more.

    Prefix filtering: in any one order of tokens, two bags of this similarity share one of the first n - ceil(t * n) + 1 of
    each, repeats numbered; only these are join keys, the rarer tokens first. The places of a key in both bound what the bags
    may share, and so do sketches of a bit for each token or two: bags differ in as many tokens at least as their sketches do
    in bits. The whole bags move for the pairs that this leaves alone, and these are scored. Tokens are compared by hashes of
    64 bits. A threshold of 0 or less, which every pair meets, compares them all.
    """
    return _links(keyed(tokens), threshold)


def _links(rows: DataFrame, threshold: float) -> DataFrame:
    if threshold > 1:
        raise ValueError("threshold must be 1 at most")
    first = stash(rows.groupBy("h1", "h2").agg(F.min("row_idx").alias("bag")).select("bag"), "first")
    own = rows.join(_small(first), F.col("row_idx") == F.col("bag")).select("bag", F.size("tokens").alias("n"), F.array_sort(F.transform("tokens", lambda t: F.xxhash64(t))).alias("h"))
    if threshold <= 0:
        sets = stash(_sets(own), "sets")
        pairs = sets.select(F.col("bag").alias("a")).join(sets.select(F.col("bag").alias("b")), F.col("a") < F.col("b"))
    else:
        marks = stash(_marked(own, threshold), "marks")
        prefix = marks.select("bag", "n", F.posexplode("keys").alias("p", "t"))
        a, b = (prefix.select("t", F.col("bag").alias(x), F.col("n").alias("n" + x), F.col("p").alias("p" + x)) for x in "ab")
        shared = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # at most, from this token on
        enough = shared >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9
        met = a.join(b, "t").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9) & enough)
        met = stash(met.select("a", "b").distinct(), "met")
        near = _differ(F.col("va"), F.col("vb")) <= (F.col("na") + F.col("nb")) * ((1 - threshold) / (1 + threshold)) + 1e-9
        pairs = _compared(met, marks.select("bag", "n", F.col("sketch").alias("v")), "pairs", lambda both: both.where(near).select("a", "b"))
        heads = stash(pairs.select(F.col("a").alias("bag")).unionByName(pairs.select(F.col("b").alias("bag"))).distinct(), "heads")
        sets = stash(_sets(own.join(_small(heads), "bag", "left_semi")), "sets")
    score = m.jaccard_ratio(F.size(F.array_intersect("va", "vb")), F.col("na"), F.col("nb")).alias("score")
    passed = lambda both: both.select("a", "b", score).where(F.col("score") >= F.lit(threshold).cast("float"))
    return _compared(pairs, sets.select("bag", "n", F.col("ts").alias("v")), "scored", passed)


def duplicates(tokens: DataFrame, threshold: float) -> DataFrame:
    """(i, j, score): all pairs of rows, i < j, of this similarity or more; two empty bags have 1.

    The result has a row for each pair, copies too; duplicate_groups() has the same links without expanding copies.
    """
    rows = keyed(tokens)
    own = membership(rows)
    a, b = own.select(F.col("row_idx").alias("x"), F.col("bag").alias("a")), own.select(F.col("row_idx").alias("y"), F.col("bag").alias("b"))
    equal = a.join(b, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("i"), F.col("y").alias("j"), F.lit(1.0).cast("float").alias("score"))
    other = _links(rows, threshold).join(a, "a").join(b, "b").select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "score")
    return equal.unionByName(other)


def duplicate_groups(tokens: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Membership (row_idx, bag) and links (a, b, score) between different bags."""
    rows = keyed(tokens)
    return membership(rows), _links(rows, threshold)


def signatures(tokens: DataFrame, k: int = 128) -> DataFrame:
    """tokens with the column signature."""
    return tokens.withColumn("signature", m.minhash(F.col("tokens"), k))
