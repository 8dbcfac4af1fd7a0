"""SimHash near-duplicates with pigeonring candidate filtering (operator 6).

A 64-bit fingerprint is cut into `max_bits + 1` consecutive segments that form a ring. If two fingerprints differ in at
most t bits, the ring has a start from which every chain of l consecutive segments differs in at most l * t / m bits
(m segments): the first segment then agrees wholly. Segments are the keys of the candidate join, longer chains prune its
pairs, and the full Hamming distance is computed only for what is left.

A segment that more than `bucket` different fingerprints share would make all pairs of a group. Its fingerprints go an
exact way that is linear: two fingerprints at distance 2 or less have a common point at distance 1 or less from both, so
each is listed under itself and its 64 one-bit neighbours, and those that meet are linked to the smallest of them.

Defined cases: null, empty and blank texts have fingerprint 0 and are linked like any other; equal rows and ties share a
fingerprint; a null doc_id takes part, and counts as the largest id; an empty table gives an empty table; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.llm.common import components, drop_rows, maybe_broadcast, scope, stash, text_key

_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.float64)


def majority(digests: list[list[bytes]]) -> np.ndarray:
    """The majority fingerprint of each list of 8-byte big-endian hashes; 0 for an empty list."""
    sizes = np.fromiter(map(len, digests), dtype=np.int64, count=len(digests))
    flat = np.frombuffer(b"".join(b"".join(x) for x in digests), dtype=np.uint8).reshape(-1, 8)
    row = np.repeat(np.arange(len(digests)) * 256, sizes)
    out = np.zeros((len(digests), 8), dtype=np.uint8)
    for byte in range(8):
        seen = np.bincount(row + flat[:, byte], minlength=len(digests) * 256).reshape(-1, 256)
        out[:, byte] = np.packbits(2 * (seen @ _BITS) > sizes[:, None], axis=1)[:, 0]
    return out.view(">u8")[:, 0].astype(np.uint64)


def shingle_digests(text: str | None, words: int) -> list[bytes]:
    """XXH64 (seed 42) of the shingles of a text, A-Z lower-cased, words apart by ASCII white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.split and lower know ASCII only
    if not parts:
        return []
    digest = xxhash.xxh64_digest
    whole = b" ".join(parts)
    if len(parts) < words:
        return [digest(whole, 42)]
    starts, at = [], 0
    for p in parts:
        starts.append(at)
        at += len(p) + 1
    ends = [*starts[words:], at]
    return [digest(whole[a : b - 1], 42) for a, b in zip(starts, ends, strict=False)]


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, th, fp) of every document: its id, the key of its text and its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = batch.columns
            found, held, size = [], [], 0
            for text in texts:
                held.append(shingle_digests(text.as_py(), words))
                size += len(held[-1])
                if size > 500_000:
                    found.append(majority(held))
                    held, size = [], 0
            found.append(majority(held))
            yield pa.record_batch([ids, keys, pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "th", "fp"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, th long, fp long")


def _segments(m: int) -> list[tuple[int, int]]:
    """(shift, bits) of m consecutive segments of 64 bits."""
    cuts = [round(64 * i / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _segment(fp: Column, i: int, cuts: list[tuple[int, int]]) -> Column:
    return F.shiftrightunsigned(fp, cuts[i][0]).bitwiseAND(F.lit((1 << cuts[i][1]) - 1).cast("long"))


def links(nodes: DataFrame, max_bits: int = 2, bucket: int = 32) -> DataFrame:
    """(a, b): fingerprints of nodes(fp), all different, whose links join exactly those that are linked at max_bits or fewer.

    Every link within segments of at most `bucket` fingerprints is there; those within larger ones are joined through a
    common neighbour, so that what is reachable is the same.
    """
    if max_bits != 2:
        raise ValueError("the exact way of large segments is that of two bits")
    m = max_bits + 1
    cuts = _segments(m)
    keys = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _segment(F.col("fp"), i, cuts).alias("seg")) for i in range(m)])).alias("k")).select("fp", "k.i", "k.seg")
    sizes = keys.groupBy("i", "seg").agg(F.count("*").alias("n")).where("n > 1")
    keys = stash(keys.join(sizes, ["i", "seg"]), "segments")

    few = keys.where(F.col("n") <= bucket)
    a, b = few.select("i", "seg", F.col("fp").alias("a")), few.select("i", "seg", F.col("fp").alias("b"))
    pairs = a.join(b, ["i", "seg"]).where("a < b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    for length in range(2, m):
        # The chain that starts at segment i and has this length.
        chain = F.lit(None)
        for i in range(m):
            bits = sum((F.bit_count(_segment(differ, (i + j) % m, cuts)) for j in range(1, length)), F.lit(0))
            chain = F.when(F.col("i") == i, bits).otherwise(chain)
        pairs = pairs.where(chain <= length * max_bits // m)
    pairs = pairs.where(F.bit_count(differ) <= max_bits).select("a", "b").distinct()

    many = keys.where(F.col("n") > bucket).select("fp").distinct()
    near = F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda x: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x)))))
    meet = many.select("fp", near.alias("v")).groupBy("v").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)  # 65 at most
    stars = meet.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b")).distinct()
    return pairs.unionByName(stars)


def simhash_groups(docs: DataFrame, words: int = 3, max_bits: int = 2, bucket: int = 32) -> DataFrame:
    """(doc_id, th, fp, component_id): component_id is the smallest doc_id reachable over links of max_bits or fewer."""
    return groups_of(stash(fingerprints(docs, words), "prints"), max_bits, bucket)


def groups_of(prints: DataFrame, max_bits: int = 2, bucket: int = 32) -> DataFrame:
    """The same of prints(doc_id, th, fp), a table."""
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "nodes")
    roots = stash(components(links(nodes.select("fp"), max_bits, bucket)), "roots")
    named = roots.join(nodes, roots["node"] == nodes["fp"])
    names = named.groupBy("root").agg(F.min("low").alias("component"))
    labels = roots.join(names, "root").select(F.col("node").alias("fp"), "component")
    alone = nodes.where("n > 1").join(roots, nodes["fp"] == roots["node"], "left_anti").select("fp", F.col("low").alias("component"))
    labels = stash(labels.unionByName(alone), "labels")
    out = prints.join(maybe_broadcast(labels, labels.count()), "fp", "left")
    return out.select("doc_id", "th", "fp", F.coalesce("component", "doc_id").alias("component_id"))


def dedup(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """docs with one document of each group: the one of the smallest doc_id, of copies of a row the first."""
    with scope(docs.sparkSession):
        groups = simhash_groups(docs, words, max_bits)
        return one_of_each(docs, groups.withColumn("grp", F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("x"))))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with the least (doc_id, th), null last, of each grp of groups(doc_id, th, grp), which is called within a scope."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = groups.groupBy("grp").agg(F.min(order).alias("w"), F.count("*").alias("n")).where("n > 1")
    lost = groups.join(first, "grp").where(order != F.col("w"))
    gone = stash(lost.select("doc_id", "th").distinct(), "gone", outer=True)
    left = drop_rows(docs, gone, gone.count())
    again = groups.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").join(gone, ["doc_id", "th"], "left_anti").drop("n")
    again = stash(again, "again", outer=True)
    if not (rows := again.count()):
        return left
    rest = drop_rows(left, again, rows)
    keys = again.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    copies = left.join(maybe_broadcast(keys, rows), left["doc_id"].eqNullSafe(keys["__id"]) & (text_key(left["text"]) == keys["__th"]), "left_semi")
    return rest.unionByName(copies.dropDuplicates(["doc_id", "text"]))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document, by the contract of operator 6."""
    return simhash_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
