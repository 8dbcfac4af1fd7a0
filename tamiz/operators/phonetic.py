"""The phonetic index, exact and fuzzy probes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions.phonetic import encode, variants

Encode = Callable[[str], tuple[str, str]]


def exact(codes: DataFrame, query: str, encode: Encode = encode) -> DataFrame:
    """codes(row_idx, pri, sec, ...) that share a code with the query, with probe: 0 where its primary code is the row's
    primary one, 1 the secondary one, 2 and 3 its secondary code likewise."""
    pri, sec = encode(query)
    probe = F.when(F.col("pri") == pri, 0).when(F.col("sec") == pri, 1).when(F.col("pri") == sec, 2).when(F.col("sec") == sec, 3)
    return codes.where(F.col("pri").isin(pri, sec) | F.col("sec").isin(pri, sec)).withColumn("probe", probe)


def _around(pri: str, sec: str, distance: int) -> dict[str, tuple[int, int]]:
    near = {code: (1, d) for code, d in variants(sec, distance).items()} if sec != pri else {}
    return near | {code: (0, d) for code, d in variants(pri, distance).items()}


def ball(spark: SparkSession, query: str, distance: int, encode: Encode = encode) -> DataFrame:
    """(code, ring, distance): codes within this many edits of the query's primary code, ring 0, and those that are only
    near its secondary one, ring 1. Bounded by the length of a code: some ten thousands at distance 2."""
    near = _around(*encode(query), distance)
    return spark.createDataFrame([(c, *x) for c, x in sorted(near.items())], "code string, ring int, distance int")


def balls(keys: DataFrame, distance: int) -> DataFrame:
    """(q_idx, code, ring, distance): the same for each of keys(q_idx, pri, sec)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for q, pri, sec in df.itertuples(index=False):
                near = _around(pri, sec, distance)
                yield pd.DataFrame([(q, c, *x) for c, x in near.items()], columns=["q_idx", "code", "ring", "distance"])

    return keys.select("q_idx", "pri", "sec").mapInPandas(run, "q_idx long, code string, ring int, distance int")


def fuzzy(codes: DataFrame, query: str, distance: int) -> DataFrame:
    """codes with distance: exact matches, at 0, if there are any, else those whose codes are within `distance` edits."""
    hits = exact(codes, query)
    if distance == 0 or hits.limit(1).count():
        return hits.withColumn("distance", F.lit(0)).drop("probe")
    return near(codes, query, distance)


def near(codes: DataFrame, query: str, distance: int, encode: Encode = encode) -> DataFrame:
    """codes with distance, of those that are within so many edits of one of the query's codes, but have none of them."""
    around = ball(codes.sparkSession, query, distance, encode)
    keys = codes.select("row_idx", F.explode(F.array("pri", "sec")).alias("code"))
    # A row is as far as its nearest code around the primary code, if there is one, else around the secondary one.
    found = keys.join(F.broadcast(around), "code").groupBy("row_idx").agg(F.min(F.struct("ring", "distance"))["distance"].alias("distance"))
    return codes.join(found, "row_idx")


def key_counts(codes: DataFrame) -> DataFrame:
    """One row: different primary codes, different secondary codes, and rows."""
    return codes.agg(F.countDistinct("pri").alias("primary_keys"), F.countDistinct("sec").alias("secondary_keys"), F.count("*").alias("total_records"))


def index(codes: DataFrame) -> DataFrame:
    """(code, slot, row_idx): the inverted index, a row for each code of a row; slot is pri or sec."""
    each = F.explode(F.array(F.struct(F.col("pri").alias("code"), F.lit("pri").alias("slot")), F.struct(F.col("sec").alias("code"), F.lit("sec").alias("slot"))))
    return codes.select("row_idx", each.alias("k")).select("k.code", "k.slot", "row_idx")


def sound_alike(groups: DataFrame) -> DataFrame:
    """(grp, alike) of groups(grp, pri): whether all of a group share the primary code."""
    return groups.groupBy("grp").agg((F.countDistinct("pri") == 1).alias("alike"))
