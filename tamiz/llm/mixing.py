"""Mixing sources to target weights (operator 8), DataFrame functions only.

The words of each source are packed, document after document in a pseudorandom order, into blocks of `block` words (the
last is shorter). Source s has a target; as many slots of the mix as hold it are its own. A keyed pseudorandom permutation
of all slots deals them to output shards of `shard` slots, which draws each shard's source counts: those of multinomial
draws, given that every source meets its target over all shards. (Independent draws would miss a small source's target by
several per cent.) The slots of a source pass over its blocks, a pass in the order of a keyed permutation of the block
indexes (the short block ends a pass): every block is used before any is used again. Blocks and slots meet in an equi-join
on (source, block index); what is taken of a document is the sum of what the shards' slots take.

The permutations are swap-or-not shuffles (Hoang, Morris, Rogaway 2012): in each round an index x and its mirror k - x, for
the round's key k, change places or not, by a hash of the larger one. They need no table, hold for any number of indexes,
and no step leaves 64 bits.

No place is beyond three uses, as a target is at most three times the source's size, which is three whole passes. The
last slot of a source takes only what the target still lacks.

Running totals over a source are kept in two levels, totals of hash buckets and totals within a bucket, so a source that
holds a third of all documents is never in one task.

Defined cases: a null source is a source, the last; null, empty and blank texts have size 0 and are taken 0 times;
repeated rows are separate documents; ties in the order are between equal rows only, which are alike; an empty table
gives an empty table; columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.common import let, maybe_broadcast, scope, stash, text_key

WORD = r"[^\x20\x09-\x0D]+"
#: Rounds of the permutations.
ROUNDS = 16


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, th, size) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_key().alias("th"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(totals: DataFrame) -> DataFrame:
    """totals(source, source_size) with k, the source's rank from 0, weight and target.

    Weights 1, 2, 3 repeat over the sources by code point, null last. Targets are weight * level, but at most three times
    the source's size, with the one level at which they add up to all sizes: what sharing the excess again and again ends in.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))  # a row for each source
    t = totals.withColumn("k", F.row_number().over(order) - 1).withColumn("weight", (F.col("k") % 3 + 1).cast("double"))
    rise = Window.orderBy(3 * F.col("source_size") / F.col("weight"), "k")
    whole = Window.partitionBy()
    t = t.withColumn("full", F.coalesce(F.sum(3 * F.col("source_size")).over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("open", F.sum("weight").over(rise.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("level", (F.sum("source_size").over(whole) - F.col("full")) / F.col("open"))
    # The level is that of the first source, by rising cap, that it doesn't fill.
    t = t.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= 3 * F.col("source_size"), F.struct(F.lit(3) * F.col("source_size") / F.col("weight"), F.col("k"), F.col("level").alias("level")))).over(whole)["level"])
    cap = (3 * F.col("source_size")).cast("double")
    target = F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap))
    return t.select("source", "source_size", "k", "weight", target.alias("target"))


def packed(docs: DataFrame, block: int, bucket_rows: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows (k, doc_id, th, size, start, source_size, target) and sources (k, source, source_size, target, blocks, slots)."""
    with scope(docs.sparkSession):
        return _packed(docs, block, bucket_rows, seed)


def _packed(docs: DataFrame, block: int, bucket_rows: int, seed: int) -> tuple[DataFrame, DataFrame]:
    rows = stash(sizes(docs), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = targets(totals.select("source", "source_size")).join(totals.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cells = F.ceil(F.col("source_size") / block)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    slots = passes * cells + F.ceil((F.ceil("target") - passes * F.col("source_size")) / block)
    sources = stash(sources.withColumn("blocks", cells).withColumn("slots", slots).withColumn("buckets", F.ceil(F.col("n") / bucket_rows)).drop("n"), "sources", outer=True)

    known = maybe_broadcast(sources.select(F.col("source").alias("s"), "k", "buckets", "source_size", "target"), sources.count(), 128)
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("o", F.xxhash64("doc_id", "th", F.lit(seed))).withColumn("bucket", F.pmod(F.xxhash64("o", F.lit(1)), "buckets"))
    within = Window.partitionBy("k", "bucket")
    before = F.sum("size").over(within.orderBy("o", "doc_id", "th").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("inner", F.coalesce(before, F.lit(0)))
    sums = rows.groupBy("k", "bucket").agg(F.sum("size").alias("all"))
    along = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("k").alias("k2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("all").over(along), F.lit(0)).alias("outer"))
    rows = rows.join(sums, (F.col("k") == F.col("k2")) & (F.col("bucket") == F.col("b2")))
    rows = rows.select("k", "doc_id", "source", "th", "size", "source_size", "target", (F.col("outer") + F.col("inner")).alias("start"))
    return stash(rows, "packed", outer=True), sources


def turns(k: Column, seed: int) -> Column:
    """The rounds' keys of a permutation."""
    return F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda i: F.xxhash64(k.cast("long"), i, F.lit(seed)))


def permuted(j: Column, n: Column, keys: Column) -> Column:
    """Index j below n under the permutation of these keys."""

    def turn(x: Column, key: Column) -> Column:
        mirror = F.pmod(F.pmod(key, n) - x, n)
        return F.when(F.xxhash64(key, F.greatest(x, mirror)).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(x)

    return F.aggregate(keys, j.cast("long"), turn)


def draw(sources: DataFrame, block: int, shard: int, seed: int) -> DataFrame:
    """(shard, slot, k, block, words): the slots of all shards, and how many words of its block each takes."""
    first = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # a row for each source
    s = sources.where("slots > 0").withColumn("first", F.coalesce(F.sum("slots").over(first), F.lit(0)))
    s = s.withColumn("every", F.sum("slots").over(Window.partitionBy()))
    # Slots are listed in runs of 4096, so that no source's list is in one row, and the runs are dealt to many tasks.
    runs = s.withColumn("turns", turns(F.col("k"), seed + 2)).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / 4096))))
    every = sources.agg(F.sum("slots")).first()[0] or 0
    runs = runs.repartition(max(sources.sparkSession.sparkContext.defaultParallelism, every // 100_000), "k", "run")
    j = runs.withColumn("j", F.explode(F.sequence(F.col("run") * 4096, F.least(F.col("run") * 4096 + 4095, F.col("slots") - 1))))
    full, inner = F.floor(F.col("source_size") / block), F.pmod("j", "blocks")
    at = permuted(F.col("first") + F.col("j"), F.col("every"), turns(F.lit(-1), seed))
    # Written, as the permutations would else be made again for each condition on what they give.
    j = j.select("k", "j", "source_size", "blocks", "target", full.alias("full"), inner.alias("inner"), at.alias("at"), permuted(inner, F.greatest(full, F.lit(1)), F.col("turns")).alias("index"))
    j = stash(j, "slots")
    index = F.when(F.col("inner") < F.col("full"), F.col("index")).otherwise(F.col("full"))
    width = F.when(F.col("inner") < F.col("full"), F.lit(block)).otherwise(F.col("source_size") - F.col("full") * block)
    rest = F.ceil("target") - F.floor(F.col("j") / F.col("blocks")) * F.col("source_size") - F.col("inner") * block
    return j.select(F.floor(F.col("at") / shard).alias("shard"), F.pmod("at", F.lit(shard)).alias("slot"), "k", index.alias("block"), F.least(width, rest).cast("long").alias("words"))


def shard_counts(slots: DataFrame) -> DataFrame:
    """(shard, k, n): the source counts of each shard."""
    return slots.groupBy("shard", "k").agg(F.count("*").alias("n"))


def pieces(rows: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """(shard, slot, k, doc_id, th, start, word, words): what each slot takes of each document, from which word of it on."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    cut = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), last)))
    cut = cut.select("k", "block", "doc_id", "th", "start", "size", F.greatest(F.lit(0), F.col("block") * block - F.col("start")).alias("word"))
    both = cut.join(slots.hint("merge"), ["k", "block"])  # slots grow with the input, which the planner doesn't see
    head = F.col("start") + F.col("word") - F.col("block") * block  # of the piece in the block
    words = F.least(F.col("size") - F.col("word"), F.col("words") - head)
    return both.select("shard", "slot", "k", "doc_id", "th", "start", "word", words.alias("words")).where("words > 0")


def mixed_texts(docs: DataFrame, block: int = 64, shard: int = 4096, seed: int = 11) -> DataFrame:
    """(shard, slot, start, doc_id, source, words): the mix itself, each slot's pieces, the words of a piece joined by spaces.

    A slot's pieces stand in the order of start. Blocks and slots meet without texts; a document's pieces, no more than three
    times its blocks, then go to its text together, which moves once.
    """
    rows, sources = packed(docs, block, 2000, seed)
    cut = pieces(rows, draw(sources, block, shard, seed), block).join(maybe_broadcast(sources.select("k", "source"), sources.count()), "k")
    piece = F.struct("shard", "slot", "start", "source", (F.col("word") + 1).cast("int").alias("word"), F.col("words").cast("int").alias("words"))
    own = cut.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_list(piece).alias("all"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), "text")
    again = stash(rows.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    if copies := again.count():  # repeated rows: their pieces are together already
        many = maybe_broadcast(again.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2")), copies)
        same = texts["doc_id"].eqNullSafe(many["d2"]) & (texts["th"] == many["t2"])
        texts = texts.join(many, same, "left_anti").unionByName(texts.join(many, same, "left_semi").dropDuplicates(["doc_id", "th"]))
    both = texts.join(own, texts["doc_id"].eqNullSafe(own["d"]) & (texts["th"] == own["t"]))
    said = let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda words: F.transform("all", lambda p: F.struct(p["shard"].alias("shard"), p["slot"].alias("slot"), p["start"].alias("start"), p["source"].alias("source"), F.array_join(F.slice(words, p["word"], p["words"]), " ").alias("words"))))
    return both.select("doc_id", F.explode(said).alias("x")).select("x.shard", "x.slot", "x.start", "doc_id", "x.source", "x.words")


def mix(docs: DataFrame, block: int = 64, shard: int = 4096, seed: int = 11) -> DataFrame:
    """(doc_id, source, th, size, source_size, target, taken, first_shard) of every row: the words that the shards' slots take
    of it, and the first shard that has some."""
    rows, sources = packed(docs, block, 2000, seed)
    taken = pieces(rows, draw(sources, block, shard, seed), block).groupBy("k", "start").agg(F.sum("words").alias("got"), F.min("shard").alias("first_shard"))
    taken = taken.select(F.col("k").alias("k2"), F.col("start").alias("s2"), "got", "first_shard")
    out = rows.join(taken, (F.col("k") == F.col("k2")) & (F.col("start") == F.col("s2")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "source", "th", "size", "source_size", "target", F.coalesce("got", F.lit(0)).alias("taken"), "first_shard")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, by the contract of operator 8."""
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "first_shard")
