"""Helpers that the training-data operators share: the shared folder, cut lineage, size-checked joins, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions.once import let

__all__ = ["BROADCAST_BYTES", "arrow_rows", "components", "drop_rows", "first_by_hash", "fresh", "let", "maybe_broadcast", "no_shuffles_left", "remove", "scope", "shared_dir", "stash", "table", "text_key", "unstash"]

#: Bytes up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32_000_000
#: Rows of a batch that goes to Python, at most, while a table is written.
ARROW_ROWS = 1000
#: Spark's setting by which a write's shuffle files go as soon as it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a local one only where none is set and all is on one
    machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tamiz-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: For each open scope, the folders that were written in it.
_scopes: list[list[str]] = []


@contextmanager
def arrow_rows(spark: SparkSession, most: int = ARROW_ROWS) -> Iterator[None]:
    """Batches that go to Python within have so many rows at most, as texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= most:
        spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files: the table has all that they were for."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stash(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it again: its lineage and its shuffle files end there, and a lost executor
    loses nothing.

    It is removed with the scope that it is written in; with the one around that, if there is one, if `outer`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with arrow_rows(spark), no_shuffles_left(spark):
        df.write.parquet(path)
    for paths in (_scopes[:-1] if outer else _scopes)[-1:]:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def unstash(df: DataFrame) -> None:
    """Removes the files of a stashed table that nothing reads any more."""
    remove(df.sparkSession, df.stashed)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables stashed within are removed at the end: what is made of them must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def maybe_broadcast(df: DataFrame, rows: int, width: int = 64) -> DataFrame:
    """df, which has so many rows of so many bytes in memory, marked for broadcast if it is small enough."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def text_key(text: Column | str = "text") -> Column:
    """A 64-bit key of a text; with doc_id it tells rows apart, and rows that it doesn't are copies."""
    text = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(7))


def first_by_hash(rows: DataFrame, key: Column, sample: int) -> DataFrame:
    """The different rows of the smallest hashes, about `sample` and no more. Only hashes are gathered to find the largest of
    these; the rows themselves stay where they are."""
    name = fresh(rows, "hash")
    keyed = rows.withColumn(name, key)
    count = rows.count()
    if count > 2 * sample:
        keyed = keyed.where(F.col(name) < F.lit(int(-(2**63) + 2**64 * 1.5 * sample / count)))
    last = keyed.select(name).distinct().orderBy(name).limit(sample).agg(F.max(name)).first()[0]
    return keyed.where(F.col(name) <= F.lit(last)).dropDuplicates([name]).drop(name)


def drop_rows(docs: DataFrame, gone: DataFrame, rows: int) -> DataFrame:
    """docs without the rows whose (doc_id, text_key) are in gone(doc_id, th), which has so many rows."""
    keys = gone.select(F.col("doc_id").alias("__gone_id"), F.col("th").alias("__gone_th"))
    match = docs["doc_id"].eqNullSafe(keys["__gone_id"]) & (text_key(docs["text"]) == keys["__gone_th"])
    return docs.join(maybe_broadcast(keys, rows), match, "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges(a long, b long): root is the smallest node reachable, itself included.

    Alternates large-star and small-star steps; each step is a grouped minimum, which combines before its shuffle,
    and an equi-join, and each round's edges are written to the shared folder.
    """
    e = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        old, e = e, stash(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        unstash(old)
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
