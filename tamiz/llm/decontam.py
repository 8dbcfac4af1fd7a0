"""Benchmark decontamination with spaced seeds (operator 2), DataFrame functions only.

A token is a run of letters and digits of the lower-cased text. At each position of a text, each fixed mask hashes the
tokens that it selects and ignores the others, so a seed is found in spite of substitutions at ignored positions. Seeds
of the documents meet those of the benchmark in an equi-join; around each hit the two token sequences are laid along the
diagonal of the hit, and a benchmark item is reported when some `window` consecutive tokens of it (all of them, if it
has fewer) agree with the document in at least `agree` of the places.

The masks are complete: wherever the substitutions are that `agree` allows, in an item of whatever length, one of them
selects unchanged tokens only, so that every such overlap is found. Items of fewer than `FEW` tokens have masks of less
weight, which documents are read with only if there are such items. Other windows and shares are refused if the masks
don't cover them.

The first pass over the documents keeps of each seed but its place; only documents with hits are read again.

Defined cases: null, empty and token-free texts match nothing; repeated rows of a document or an item give one result
row; documents or items with a null id take part under it; empty tables give an empty result; of equal matches of a pair
the first in the document is reported; other columns are not read.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.llm.common import drop_rows, let, maybe_broadcast, scope, stash, text_key

#: Offsets that the masks select, for items of FEW tokens and more, for shorter ones, for two tokens and for one.
MASKS = ((0, 2, 3, 9), (0, 3, 5, 7))
SHORT = ((0, 1, 2), (0, 1, 3))
PAIR, ONE = ((0, 1),), ((0,),)
FEW = 10


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks of an item of n tokens."""
    return MASKS if n >= FEW else SHORT if n > 2 else PAIR if n == 2 else ONE


@cache
def complete(width: int, changes: int) -> bool:
    """Whether any so many substitutions in `width` tokens leave a mask at some position unchanged."""
    places = [{o + i for i in m} for m in masks_of(width) for o in range(width - m[-1])]
    return all(any(not x.intersection(some) for x in places) for some in combinations(range(width), changes))


def tokens(text: Column) -> Column:
    """Hashes of the tokens of a text, in order."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""), lambda t: F.xxhash64(t))


def seeds(h: Column, offsets: tuple[int, ...]) -> Column:
    """The hash of the selected tokens at each position of h where the whole mask fits."""
    span = offsets[-1] + 1
    at = lambda i: F.xxhash64(*[F.get(h, i + o) for o in offsets], F.lit("-".join(map(str, offsets))))
    return F.when(F.size(h) >= span, F.transform(F.sequence(F.lit(0), F.size(h) - span), at)).otherwise(F.array().cast("array<bigint>"))


def placed(p: Column, n: Column, masks: list[tuple[int, ...]]) -> Column:
    """The position that a place in the joined lists of the masks' seeds stands for, in a text of n tokens."""
    out, before = F.lit(None).cast("int"), F.lit(0)
    for m in masks:
        own = F.greatest(n - m[-1], F.lit(0))
        out = F.coalesce(out, F.when(p < before + own, p - before))
        before = before + own
    return out


def agreement(item: Column, doc: Column, window: int) -> Column:
    """Struct (best, width, at): the most agreeing places of any `width` consecutive item tokens, and the first such
    window; doc holds the tokens that lie along the item, null where the document doesn't reach."""
    width = F.least(F.size(item), F.lit(window))

    def best(sums: Column) -> Column:
        top = F.array_max(sums)
        return F.struct(top.alias("best"), width.alias("width"), (F.array_position(sums, top).cast("int") - 1).alias("at"))

    def totals(same: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.size(item) - width), lambda i: F.aggregate(F.slice(same, i + 1, width), F.lit(0), lambda a, x: a + x))
        return let(sums, best)

    return let(F.zip_with(item, doc, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), totals)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 16, agree: float = 0.8) -> DataFrame:
    """(doc_id, th, item_id, matched, width, start, item_start): verified overlaps, the best of each document row and item."""
    for width in range(1, window + 1):
        if not complete(width, width - math.ceil(width * agree)):
            raise ValueError(f"the masks don't cover {agree} of {width} tokens")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("item")).where(F.size("item") > 0).distinct()
    items = stash(items.withColumn("ik", F.xxhash64("item_id", "item")), "items")
    n = F.size("item")
    kinds = {"long": (MASKS, n >= FEW), "short": (SHORT, (n > 2) & (n < FEW)), "pair": (PAIR, n == 2), "one": (ONE, n == 1)}
    there = items.agg(*[F.coalesce(F.max(c), F.lit(False)).alias(k) for k, (_, c) in kinds.items()], F.coalesce(F.sum(n), F.lit(0)).alias("all"), F.count("*").alias("rows")).first()
    kinds = {k: x for k, x in kinds.items() if there[k]}
    masks = [m for own, _ in kinds.values() for m in own]

    wanted = None
    for own, mine in kinds.values():
        each = items.where(mine).select("ik", n.alias("n"), F.posexplode(F.concat(*[seeds(F.col("item"), m) for m in own])).alias("p", "seed"))
        each = each.select("seed", "ik", "n", placed(F.col("p"), F.col("n"), list(own)).alias("r"))
        wanted = each if wanted is None else wanted.unionByName(each)
    if wanted is None:
        wanted, masks = items.select(F.lit(0).cast("long").alias("seed"), "ik", F.lit(0).alias("n"), F.lit(0).alias("r")), [(0,)]
    wanted = stash(wanted.distinct(), "seeds")

    # h is named once: each seed's row holds but the document's keys and the place.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), "text")
    listed = let(tokens(F.col("text")), lambda h: F.struct(F.size(h).alias("m"), F.concat(*[seeds(h, m) for m in masks]).alias("s")))
    listed = keyed.select("doc_id", "th", listed.alias("x")).select("doc_id", "th", "x.m", F.posexplode("x.s").alias("p", "seed"))
    hits = listed.join(maybe_broadcast(wanted, wanted.count(), 40), "seed")
    hits = hits.select("doc_id", "th", "ik", "n", (placed(F.col("p"), F.col("m"), masks) - F.col("r")).alias("diag")).distinct()
    # A document's hits together, so that its tokens are made once.
    own = stash(hits.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_list(F.struct("ik", "n", "diag")).alias("hits")), "hits")
    rows, every = own.agg(F.count("*"), F.coalesce(F.sum(F.size("hits")), F.lit(0))).first()
    both = keyed.join(maybe_broadcast(own, rows, 40 + 24 * every // max(1, rows)), keyed["doc_id"].eqNullSafe(own["d"]) & (keyed["th"] == own["t"]))

    def along(h: Column, x: Column) -> Column:
        """The document's tokens along an item; null before it begins. diag is the item's start, below 0 if that is outside."""
        head = F.array_repeat(F.lit(None).cast("long"), F.greatest(F.lit(0), -x["diag"]))
        return F.concat(head, F.slice(h, F.greatest(x["diag"], F.lit(0)) + 1, x["n"] + F.least(x["diag"], F.lit(0))))

    laid = let(tokens(F.col("text")), lambda h: F.transform("hits", lambda x: F.struct(x["ik"].alias("ik"), x["diag"].alias("diag"), along(h, x).alias("along"))))
    laid = both.select("doc_id", "th", F.explode(laid).alias("x")).select("doc_id", "th", "x.*")
    found = laid.join(maybe_broadcast(items, there["rows"], 64 + 8 * there["all"] // max(1, there["rows"])), "ik")
    # Verified before the filter and written, as the optimizer would put it in the filter again.
    found = found.select("doc_id", "th", "item_id", "diag", agreement(F.col("item"), F.col("along"), window).alias("m"))
    found = stash(found, "verified").where(F.col("m.best") >= F.ceil(F.col("m.width") * agree))
    best = F.max(F.struct(F.col("m.best").alias("matched"), (-(F.col("diag") + F.col("m.at"))).alias("neg"), F.col("m.width").alias("width"), F.col("m.at").alias("item_start")))
    best = found.groupBy("doc_id", "th", "item_id").agg(best.alias("b"))
    return best.select("doc_id", "th", "item_id", "b.matched", "b.width", (-F.col("b.neg")).alias("start"), "b.item_start")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 16, agree: float = 0.8) -> DataFrame:
    """docs without those in which a benchmark item was verified."""
    with scope(docs.sparkSession):
        gone = stash(matches(docs, benchmark, window, agree).select("doc_id", "th").distinct(), "leaks", outer=True)
    return drop_rows(docs, gone, gone.count())


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item of which it holds a passage."""
    found = matches(docs, benchmark)
    best = F.max(F.struct("matched", (-F.col("start")).alias("neg"), "width", "item_start"))
    one = found.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return one.select("doc_id", "item_id", "b.matched", F.col("b.width").alias("window"), (-F.col("b.neg")).alias("start"), "b.item_start")
