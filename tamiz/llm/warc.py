"""Merkle fixity audit of WARC replicas (operator 4), DataFrame functions only.

Records stand in archives at offsets. A record's leaf is its offset, its length and the SHA-256 of its bytes. Level 0 of a
tree has a node for each range of `reach` bytes in which a record begins, its digest that of the leaves in order of offset;
a node of each further level covers `fanout` ranges of the level below, up to one root for each archive. Ranges are by
offset and not by rank, so a lost record changes its own range and no other. The two replicas' trees are built together: a
row has the digests of one node in both.

An audit compares the replicas' roots, then goes down: on each level only the nodes below a differing one are read and
compared, and at the end only the records of differing ranges. What differs is corrupt (same place, other digest),
lost (in the first replica alone) or added (in the second alone).

An archive has the pages of PAGES ids, one behind the other. Where these are more than ROWS pages, as many have one id, they
are dealt to several volumes of the archive, each with a tree of its own. Copies of a page are put together before their
offsets are counted.

Defined cases: records at one place are paired in the order of length and digest, copies one by one; null pages and urls
count as empty; pages with a null id are in archives of their own, by a hash of the url; an empty replica loses or adds all
of the other's records; equal replicas differ nowhere, and nothing below the roots is read; replicas without volumes have
one for each archive; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.common import let, maybe_broadcast, stash

REACH = 1 << 18
FANOUT = 16
#: Page ids in one archive, and pages in one volume of it, about.
PAGES, ROWS = 1024, 4096
#: A tree is told by its archive and volume.
TREE = ("archive", "volume")


def record(url: Column, html: Column) -> Column:
    """The bytes of a WARC response record, with its own header."""
    body = F.coalesce(html, F.lit("")).cast("binary")
    size = F.octet_length(body).cast("string")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def archive(page_id: Column, url: Column) -> Column:
    """The archive of a page: that of its id; for pages without one, one far below those, by hash."""
    return F.coalesce(F.floor(page_id / PAGES), F.lit(-(1 << 62)) - F.pmod(F.xxhash64(url), F.lit(4096)))


def stored(pages: DataFrame, kept: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(page_id, archive, volume, offset, length, digest, kept_length, kept_digest): the pages' records, one behind the other
    in the order of their ids.

    kept(page_id, bytes): what a replica has in the record's place, null if it is the record; the last two columns tell of it.
    """
    page, place = F.col("page_id").cast("long"), archive(F.col("page_id").cast("long"), F.col("url"))
    crowded = stash(pages.groupBy(place.alias("archive")).agg(F.ceil(F.count("*") / ROWS).cast("int").alias("volumes")).where("volumes > 1"), "crowded")
    other = F.lit(None).cast("binary") if kept is None else None

    def told(b: Column) -> Column:
        digest, size = F.sha2(b, 256), F.octet_length(b).cast("long")
        bare = lambda x: F.struct(size.alias("length"), digest.alias("digest"), F.octet_length(x).cast("long").alias("kept_length"), F.sha2(x, 256).alias("kept_digest"))
        return let(other if kept is None else kept(page, b), bare)

    rows = pages.select(page.alias("page_id"), place.alias("archive"), let(record(F.col("url"), F.col("html")), told).alias("r"))
    rows = rows.select("page_id", "archive", "r.length", "r.digest", F.coalesce("r.kept_length", "r.length").alias("kept_length"), F.coalesce("r.kept_digest", "r.digest").alias("kept_digest"))
    rows = rows.join(maybe_broadcast(crowded, crowded.count(), 32), "archive", "left")
    rows = rows.withColumn("volume", F.coalesce(F.pmod(F.xxhash64("digest"), F.col("volumes")).cast("int"), F.lit(0)))
    once = rows.groupBy("archive", "volume", "page_id", "digest", "length", "kept_digest", "kept_length").agg(F.count("*").alias("n"))
    along = Window.partitionBy(*TREE).orderBy("page_id", "digest", "kept_digest").rowsBetween(Window.unboundedPreceding, -1)  # about ROWS pages
    once = once.withColumn("first", F.coalesce(F.sum(F.col("length") * F.col("n")).over(along), F.lit(0)))
    each = once.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.select("page_id", *TREE, (F.col("first") + F.col("i") * F.col("length")).alias("offset"), "length", "digest", "kept_length", "kept_digest")


def records(pages: DataFrame) -> DataFrame:
    """(page_id, archive, volume, offset, length, digest) of the pages' records."""
    return stored(pages).drop("kept_length", "kept_digest")


def leaves(first: DataFrame, second: DataFrame, reach: int) -> DataFrame:
    """(archive, volume, node, offset, length, digest, n0, n1): the replicas' different records, and how often each has one."""
    sides = []
    for k, rows in enumerate((first, second)):
        volume = F.col("volume") if "volume" in rows.columns else F.lit(0)
        sides.append(rows.select("archive", volume.alias("volume"), F.floor(F.col("offset") / reach).alias("node"), "offset", "length", "digest", F.lit(k).alias("side")))
    count = lambda k: F.sum((F.col("side") == k).cast("long"))
    return sides[0].unionByName(sides[1]).groupBy(*TREE, "node", "offset", "length", "digest").agg(count(0).alias("n0"), count(1).alias("n1"))


def trees(rows: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels (archive, volume, node, h0, h1) from the lowest to the roots, node 0, of leaves(): a null digest is an empty node."""

    def hashed(nodes: DataFrame, by: Column, h0: Column, h1: Column) -> DataFrame:
        """Groups in order of `at`: at most `fanout` nodes, or the records that begin in a range."""
        listed = F.array_sort(F.collect_list(F.struct("at", h0.alias("h0"), h1.alias("h1"))))
        side = lambda h: F.transform(F.filter("all", lambda x: x[h].isNotNull()), lambda x: x[h])
        out = nodes.groupBy(*TREE, by.alias("node")).agg(listed.alias("all"))
        return out.select(*TREE, "node", *[F.when(F.size(side(h)) > 0, F.sha2(F.array_join(side(h), ""), 256)).alias(h) for h in ("h0", "h1")])

    leaf = lambda n: F.when(F.col(n) > 0, F.concat_ws("|", "offset", "length", "digest", n))
    at = F.struct("offset", "length", "digest")
    levels = [stash(hashed(rows.withColumn("at", at), F.col("node"), leaf("n0"), leaf("n1")), "tree")]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while top > 0:
        levels.append(stash(hashed(levels[-1].withColumnRenamed("node", "at"), F.floor(F.col("at") / fanout), F.col("h0"), F.col("h1")), "tree"))
        top //= fanout
    return levels


def audit(first: DataFrame, second: DataFrame, reach: int = REACH, fanout: int = FANOUT) -> DataFrame:
    """(archive, volume, offset, k, status, digest, other): the records in which two replicas, as of records(), differ."""
    rows = stash(leaves(first, second, reach), "leaves")
    levels = trees(rows, fanout)
    differ = ~F.col("h0").eqNullSafe(F.col("h1"))
    wrong = stash(levels[-1].where(differ).select(*TREE, "node"), "wrong")
    for level in reversed(levels[:-1]):
        parents = maybe_broadcast(wrong.withColumnRenamed("node", "parent"), wrong.count())
        below = level.withColumn("parent", F.floor(F.col("node") / fanout)).join(parents, [*TREE, "parent"], "left_semi")
        wrong = stash(below.where(differ).select(*TREE, "node"), "wrong")
    near = rows.join(maybe_broadcast(wrong, wrong.count()), [*TREE, "node"], "left_semi").where("n0 <> n1")
    # What one replica has more of, copy by copy; those of one place are told apart by their rank there.
    each = near.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs(F.col("n0") - F.col("n1"))))).withColumn("lost", F.col("n0") > F.col("n1"))
    each = each.withColumn("k", F.row_number().over(Window.partitionBy(*TREE, "offset", "lost").orderBy("length", "digest")))
    both = each.groupBy(*TREE, "offset", "k").agg(F.max(F.when(F.col("lost"), F.col("digest"))).alias("digest"), F.max(F.when(~F.col("lost"), F.col("digest"))).alias("other"))
    status = F.when(F.col("digest").isNull(), "added").when(F.col("other").isNull(), "lost").otherwise("corrupt")
    return both.select(*TREE, "offset", "k", status.alias("status"), "digest", "other")


#: Every so many-th page of the audited copy has a flipped byte, is cut short, or is lost.
FLIPPED, SHORT, LOST = 97, 331, 499


def damaged(page: Column, b: Column) -> Column:
    """What a damaged replica has of a record, null if it is whole."""
    size = F.octet_length(b)
    # In the length's middle a byte becomes another: '~', or '!' where '~' stood.
    at = F.floor(size / 2).cast("int")
    byte = F.when(F.substring(b, at, 1) == F.lit("~").cast("binary"), F.lit("!")).otherwise(F.lit("~")).cast("binary")
    flipped = F.concat(F.substring(b, F.lit(1), at - 1), byte, F.substring(b, at + 1, size))
    return F.when(page % SHORT == 7, F.substring(b, F.lit(1), size - 5)).when(page % FLIPPED == 3, flipped)


def query(pages: DataFrame) -> DataFrame:
    """Every record of the pages with its place, digest and what an audit of a damaged replica says of it."""
    both = stash(stored(pages, damaged), "replicas")
    first = both.select("page_id", *TREE, "offset", "length", "digest")
    second = both.where(~F.coalesce(F.col("page_id") % LOST == 11, F.lit(False))).select("page_id", *TREE, "offset", F.col("kept_length").alias("length"), F.col("kept_digest").alias("digest"))
    found = stash(audit(first, second).where("status <> 'added'").select(*TREE, "offset", "digest", "status").distinct(), "audit")
    rows = first.join(maybe_broadcast(found, found.count(), 160), [*TREE, "offset", "digest"], "left")
    return rows.select("page_id", *TREE, "offset", "length", "digest", F.coalesce("status", F.lit("ok")).alias("status"))


#: The same for page ids that are there once: DuckDB compares every record, no tree is needed.
SQL = f"""
WITH r AS (
  SELECT page_id, page_id // {PAGES} AS archive,
         encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS body
  FROM pages)
SELECT page_id, archive, 0::INTEGER AS volume,
       CAST(coalesce(sum(octet_length(body)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
       CAST(octet_length(body) AS BIGINT) AS length, sha256(body) AS digest,
       CASE WHEN page_id % {LOST} = 11 THEN 'lost' WHEN page_id % {SHORT} = 7 OR page_id % {FLIPPED} = 3 THEN 'corrupt' ELSE 'ok' END AS status
FROM r
"""
