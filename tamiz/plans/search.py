"""One entry for all searches: the algorithm picks the plan."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from enum import IntEnum

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions import kernels
from tamiz.functions import measures as m
from tamiz.functions import text as tx
from tamiz.operators import edit, vectors
from tamiz.operators import phonetic as ph
from tamiz.sources.catalog import Catalog

RESULT = "rank int, id string, name string, score double"
#: Rows of a result, the score that a scan's rows must exceed, the similarity of edit search, the edits of fuzzy sound.
LIMIT, LEAST, EDIT, SOUND = 50, 0.1, 0.85, 2


class Algorithm(IntEnum):
    HAMMING = 0
    DICE = 1
    PHONETIC = 2
    DAMERAU = 3
    JACCARD = 4
    JARO_WINKLER = 5
    COSINE = 6

    @classmethod
    def of(cls, number: int) -> Algorithm:
        """The algorithm of a number; the first for one that isn't there."""
        return cls(number) if number in list(cls) else cls.HAMMING


#: Searches that leave inactive rows out by themselves: the scans.
SCANS = {Algorithm.HAMMING, Algorithm.DICE, Algorithm.JACCARD, Algorithm.JARO_WINKLER}


def _ranked(rows: DataFrame, *order: Column, limit: int) -> DataFrame:
    """The first rows in this order, numbered from 1; the number is over `limit` rows."""
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "id", "name", F.col("score").cast("double").alias("score"))


def _active(rows: DataFrame, active_only: bool) -> DataFrame:
    return rows.where(F.col("active") == 1) if active_only else rows


def _named(catalog: Catalog, rows: DataFrame) -> DataFrame:
    """rows, which a limit bounds, with the name of the first row of their id. They are made once, and go by the driver."""
    rows = rows.sparkSession.createDataFrame(rows.collect(), rows.schema)
    names = catalog.rows.join(F.broadcast(rows.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.min_by("name", "row_idx").alias("first_name"))
    return rows.drop("name").join(names, "id", "left").withColumn("name", F.coalesce("first_name", F.lit(""))).drop("first_name")


def _may_wink(name: Column, query: Column) -> Column:
    """Whether the Jaro-Winkler similarity may be above 0. Of ASCII texts, whose graphemes are their characters, those whose
    lengths differ by twice the window, or that have no letter in common, have 0."""
    n, m = F.char_length(name), F.char_length(query)
    reach = F.greatest(F.lit(0), F.floor(F.greatest(n, m) / 2) - 1)
    near = (reach == 0) | (F.abs(n - m) < 2 * reach)
    # translate() takes out the letters of the query; what it is given mustn't be longer than they are.
    common = F.char_length(F.call_function("translate", name, query, F.lit(""))) < n
    plain = (F.octet_length(name) == n) & (F.octet_length(query) == m) & ~F.contains(name, F.lit("\r")) & ~F.contains(query, F.lit("\r"))
    return ~plain | (near & common)


def scan_score(catalog: Catalog, algorithm: Algorithm, query: str) -> tuple[DataFrame, Column]:
    """The rows that a scan reads and their score; what depends on the query alone is computed once, here."""
    q = F.lit(query)
    if algorithm == Algorithm.HAMMING:
        # Other lengths score 0, which is never enough: they needn't be scored.
        return catalog.rows.where(F.octet_length("id") == len(query.encode())), m.hamming_score(F.col("id"), q)
    if algorithm == Algorithm.DICE:
        g = kernels.clusters(query)
        pairs = list(dict.fromkeys(a + b for a, b in zip(g, g[1:], strict=False)))
        return catalog.shingles, m.dice(F.col("shingles"), F.array(*[F.lit(x) for x in pairs]).cast("array<string>"))
    tokens = query_tokens(query)
    return catalog.tokens, m.jaccard(F.col("tokens"), F.array(*[F.lit(t) for t in tokens]).cast("array<string>")).cast("double")


def query_tokens(query: str) -> list[str]:
    """The word tokens of a query: the same as text.word_tokens."""
    return [w for w in regex.findall(r"[\p{Alphabetic}\p{N}]+", unicodedata.normalize("NFD", query)) if w not in tx.STOP_WORDS]


def search(catalog: Catalog, query: str, algorithm: Algorithm | int, limit: int = LIMIT, active_only: bool | None = None) -> DataFrame:
    """(rank, id, name, score): the best rows for a query, at most `limit`.

    Scans leave out inactive rows and scores of 0.1 or less, and rank by score, ties in catalogue order. Edit search has
    all rows of similarity 0.85 or more, by distance, with score 1; phonetic search those that share a code, score 1, or
    else those within two edits of one; cosine search the nearest mock embeddings. active_only overrides what an algorithm
    does about inactive rows. A blank query has no result.
    """
    algorithm = Algorithm.of(int(algorithm))
    spark = catalog.rows.sparkSession
    if not query.strip():
        return spark.createDataFrame([], RESULT)
    only = algorithm in SCANS if active_only is None else active_only
    if algorithm == Algorithm.JARO_WINKLER:
        rows = _active(catalog.rows, only)
        scored = rows.select("name").distinct().where(_may_wink(F.col("name"), F.lit(query)))
        scored = scored.withColumn("score", F.coalesce(kernels.jaro_winkler_similarity(F.col("name"), F.lit(query)), F.lit(0.0)))
        rows = rows.join(scored.where(F.col("score") > LEAST), "name")
        return _ranked(rows, F.desc("score"), F.col("row_idx"), limit=limit)
    if algorithm in SCANS:
        rows, score = scan_score(catalog, algorithm, query)
        rows = _active(rows, only).select("row_idx", "id", "name", score.alias("score")).where(F.col("score") > LEAST)
        return _ranked(rows, F.desc("score"), F.col("row_idx"), limit=limit)
    if algorithm == Algorithm.DAMERAU:
        rows = edit.search(_active(catalog.rows, only), query, EDIT, index=catalog.spelt).select("row_idx", "id", "name", "distance").orderBy("distance", "row_idx").limit(limit)
        rows = _named(catalog, rows).withColumn("score", F.lit(1.0))
        return _ranked(rows, F.col("distance"), F.col("row_idx"), limit=limit)
    if algorithm == Algorithm.PHONETIC:
        codes = catalog.codes
        if only:
            codes = codes.join(_active(catalog.rows, True).select("row_idx"), "row_idx", "left_semi")
        encode = catalog.encoder.encode
        hits = _ranked(ph.exact(codes, query, encode).withColumn("score", F.lit(1.0)), F.col("probe"), F.col("row_idx"), limit=limit).collect()
        if hits:  # `limit` rows at most; made again they would encode the catalogue again
            return spark.createDataFrame(hits, RESULT)
        rows = ph.near(codes, query, SOUND, encode).withColumn("score", m.phonetic_score(F.col("distance")))
        return _ranked(rows, F.col("distance"), F.col("row_idx"), limit=limit)
    far = vectors.distances(catalog.vectors, [float(x) for x in catalog.backend.vectors([query])[0]]).select("name", "d2")
    rows = _active(catalog.rows, only).select("row_idx", "id", "name").join(far, "name").orderBy("d2", "row_idx").limit(limit)
    rows = rows.withColumn("score", m.euclid_score(F.col("d2")))
    return _ranked(_named(catalog, rows), F.col("d2"), F.col("row_idx"), limit=limit)


def _met(asked: DataFrame, rows: DataFrame, items: str) -> DataFrame:
    """(q_idx, row_idx, inter, n, m): how many items, repeats counted, queries (items, q_idx) and rows (items, row_idx) share,
    and how many they have; of those that share any. The queries' items are broadcast if the planner finds them small."""

    def counted(df: DataFrame, key: str, size: str, times: str) -> DataFrame:
        each = df.select(key, F.size(items).alias(size), F.explode(items).alias("t"))
        return each.groupBy(key, size, "t").agg(F.count("*").alias(times))

    left, right = counted(asked, "q_idx", "n", "f"), counted(rows, "row_idx", "m", "g")
    return left.join(right, "t").groupBy("q_idx", "row_idx", "n", "m").agg(F.sum(F.least("f", "g")).alias("inter"))


def _nearest_batch(catalog: Catalog, asked: DataFrame, limit: int, block: int) -> DataFrame:
    """(q_idx, row_idx, d2): rows of the `limit` nearest names of each query, and those as near as the last. Queries go block by
    block over the names' vectors; of each batch of vectors only these are passed on."""
    found = None
    for k in range(max(1, -(-asked.count() // block))):
        part = asked.orderBy("q_idx").offset(k * block).limit(block).collect()  # a block
        ids, v = [r.q_idx for r in part], catalog.backend.vectors([r.q for r in part]) if part else np.zeros((0, 1))

        def run(batches: Iterator[pa.RecordBatch], ids=ids, v=v) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = np.stack(batch.column("vec").to_numpy(zero_copy_only=False)).astype(np.float64) if batch.num_rows else np.zeros((0, 1))
                for q, x in zip(ids, v, strict=True):
                    d2 = ((rows - np.asarray(x, dtype=np.float64)) ** 2).sum(axis=1)
                    last = np.partition(d2, limit - 1)[limit - 1] if len(d2) > limit else np.inf
                    some = np.flatnonzero(d2 <= last)
                    yield pa.record_batch([pa.array([q] * len(some), pa.int64()), batch.column("name").take(pa.array(some)), pa.array(d2[some])], names=["q_idx", "name", "d2"])

        near = catalog.vectors.select("name", "vec").mapInArrow(run, "q_idx long, name string, d2 double")
        found = near if found is None else found.unionByName(near)
    # Each name has a row at least: those of the `limit` nearest names are enough.
    near = found.withColumn("r", F.rank().over(Window.partitionBy("q_idx").orderBy("d2"))).where(F.col("r") <= limit)
    return near.join(catalog.rows.select("row_idx", "name"), "name").select("q_idx", "row_idx", "d2")


def _sounds_batch(catalog: Catalog, asked: DataFrame) -> DataFrame:
    """(q_idx, row_idx, score, o): rows that share a code with a query, or, if none does, those near one."""
    encoder = catalog.encoder
    keys = asked.select("q_idx", "q", encoder.codes(F.col("q")).alias("c")).select("q_idx", "q", "c.pri", "c.sec")
    index = ph.index(catalog.codes).withColumn("slot", F.when(F.col("slot") == "pri", 0).otherwise(1))
    each = keys.select("q_idx", F.posexplode(F.array("pri", "sec")).alias("s", "code"))
    exact = index.join(each, "code").groupBy("q_idx", "row_idx").agg(F.min(F.col("s") * 2 + F.col("slot")).alias("o"))
    rest = keys.join(exact.select("q_idx").distinct(), "q_idx", "left_anti")
    near = index.select("code", "row_idx").join(ph.balls(rest, SOUND), "code").groupBy("q_idx", "row_idx").agg(F.min(F.struct("ring", "distance"))["distance"].alias("o"))
    return exact.withColumn("score", F.lit(1.0)).unionByName(near.withColumn("score", m.phonetic_score(F.col("o"))))


def search_batch(catalog: Catalog, queries: DataFrame, algorithm: Algorithm | int, limit: int = LIMIT, block: int = 1000) -> DataFrame:
    """(q_idx, rank, id, name, score): search() for each of queries(q_idx, q), by any algorithm.

    Scans by tokens or shingles join on these, edit search by length, phonetic search by code, Hamming distance by length in
    bytes; Jaro-Winkler compares all different names and queries that its conditions leave, and cosine search all vectors,
    `block` queries at a time. Blank queries have no rows.
    """
    algorithm = Algorithm.of(int(algorithm))
    asked = queries.where(F.col("q").rlike(r"(?U)\S")).select(F.col("q_idx").cast("long").alias("q_idx"), "q")
    rows = _active(catalog.rows, algorithm in SCANS)
    order, first = [F.desc("score"), F.col("row_idx")], False  # first: whether the name is that of the id's first row
    if algorithm == Algorithm.DAMERAU:
        found = edit.search_batch(rows, asked, EDIT, index=catalog.spelt).withColumn("score", F.lit(1.0)).select("q_idx", "row_idx", "score", F.col("distance").alias("o"))
        order, first = [F.col("o"), F.col("row_idx")], True
    elif algorithm == Algorithm.PHONETIC:
        found = _sounds_batch(catalog, asked)
        order = [F.col("o"), F.col("row_idx")]
    elif algorithm == Algorithm.COSINE:
        found = _nearest_batch(catalog, asked, limit, block).withColumn("score", m.euclid_score(F.col("d2"))).withColumnRenamed("d2", "o")
        order, first = [F.col("o"), F.col("row_idx")], True
    elif algorithm == Algorithm.JACCARD:
        tokens = _active(catalog.tokens, True).select("row_idx", "tokens")
        own = asked.select("q_idx", tx.word_tokens(F.col("q")).alias("tokens"))
        found = _met(own, tokens, "tokens").select("q_idx", "row_idx", m.jaccard_ratio(F.col("inter"), F.col("n"), F.col("m")).cast("double").alias("score"))
        # Two bags without a token are alike.
        none = F.size("tokens") == 0
        bare = F.broadcast(tokens.where(none).select("row_idx").orderBy("row_idx").limit(limit))
        found = found.unionByName(own.where(none).select("q_idx").join(bare).withColumn("score", F.lit(1.0)))
    elif algorithm == Algorithm.DICE:
        shingles = _active(catalog.shingles, True).select("row_idx", "shingles")
        own = asked.select("q_idx", tx.bigram_shingles(F.col("q")).alias("shingles"))
        found = _met(own, shingles, "shingles").select("q_idx", "row_idx", (2.0 * F.col("inter") / (F.col("n") + F.col("m"))).alias("score"))
    elif algorithm == Algorithm.HAMMING:
        found = rows.join(asked, F.octet_length("id") == F.octet_length("q")).select("q_idx", "row_idx", m.hamming_score(F.col("id"), F.col("q")).alias("score"))
    else:
        names, each = rows.select("name").distinct(), asked.select("q").distinct()
        scored = names.join(each, _may_wink(F.col("name"), F.col("q"))).withColumn("score", kernels.jaro_winkler_similarity(F.col("name"), F.col("q")))
        scored = scored.where(F.col("score") > LEAST)
        found = rows.join(scored, "name").join(asked, "q").select("q_idx", "row_idx", "score")
    if algorithm in SCANS:
        found = found.where(F.col("score") > LEAST)
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("q_idx").orderBy(*order))).where(F.col("rank") <= limit)
    named = top.join(catalog.rows.select("row_idx", "id", "name"), "row_idx")  # `limit` rows for each query
    if first:
        ids = named.select("id").distinct()
        own = catalog.rows.join(ids, "id", "left_semi").groupBy("id").agg(F.min_by("name", "row_idx").alias("name"))
        named = named.drop("name").join(own, "id")
    return named.select("q_idx", "rank", "id", "name", F.col("score").cast("double").alias("score"))
