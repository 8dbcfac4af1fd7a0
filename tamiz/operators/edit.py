"""Search by Damerau-Levenshtein similarity: an exact filter, cheap conditions first."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.functions import backends
from tamiz.functions.backends import Metric
from tamiz.functions.kernels import damerau_distance, prepared
from tamiz.functions.measures import from_distance
from tamiz.functions.text import preprocess


def indexed(names: DataFrame) -> DataFrame:
    """names(name) with what the conditions read: the length in graphemes, and the lower-cased name with digits made one
    digit, null where its characters aren't the graphemes."""
    g = preprocess(F.col("name"))
    low = F.array_join(g, "")
    plain = F.when(F.char_length(low) == F.size(g), F.translate(low, "123456789", "000000000"))
    return names.withColumn("glen", F.size(g)).withColumn("plain", plain)


def most_edits(threshold: float, longest: Column) -> Column:
    """Edits that a similarity of `threshold` allows, over the longer of the two lengths."""
    return F.floor((1 - threshold) * longest + 1e-9)


def within(threshold: float, name: Column, glen: Column, plain: Column, query: Column, qlen: Column, qplain: Column, numeric_weight: int = 0, widest: int | None = None) -> tuple[Column, Column]:
    """A condition that all matches meet, in the JVM, and the distance.

    Lengths may differ by the allowed edits; and as a swap is two plain edits, Levenshtein distance with all digits alike
    is at most twice the allowed edits. `widest` bounds the edits that any pair may have.
    """
    allowed = most_edits(threshold, F.greatest(glen, qlen))
    near = F.abs(glen - qlen) <= allowed
    if widest is not None:
        lev = F.levenshtein(plain, qplain, 2 * widest)
        near = near & (plain.isNull() | qplain.isNull() | ((lev >= 0) & (lev <= 2 * allowed)))
    return near, damerau_distance(name, query, numeric_weight)


def search(names: DataFrame, query: str, threshold: float = 0.85, numeric_weight: int = 0, index: DataFrame | None = None, metric: Metric | None = None) -> DataFrame:
    """names(name, ...) whose similarity to the query is `threshold` or more, with distance and similarity.

    Different names are compared once each. index: what indexed() has made of names, or of more, built once for many searches.
    metric: another distance, for which no condition is known: it is computed for every name.
    """
    g = prepared(query)
    each = indexed(names.select("name").distinct()) if index is None else index
    if metric is not None:
        scored = each.withColumn("distance", backends.distance(metric, F.col("name"), F.lit(query)))
        scored = scored.withColumn("similarity", from_distance(F.col("distance"), F.col("glen"), F.lit(len(g)))).where(F.col("similarity") >= threshold)
        return names.join(scored.select("name", "distance", "similarity"), "name")
    low = "".join(g)
    plain = low.translate(str.maketrans("123456789", "000000000")) if len(low) == len(g) else None
    widest = math.floor((1 - threshold) * len(g) / threshold + 1) if threshold > 0 else None  # the longer one is at most len / threshold
    near, distance = within(threshold, F.col("name"), F.col("glen"), F.col("plain"), F.lit(query), F.lit(len(g)), F.lit(plain).cast("string"), numeric_weight, widest)
    scored = each.where(near).withColumn("distance", distance)
    scored = scored.withColumn("similarity", from_distance(F.col("distance"), F.col("glen"), F.lit(len(g)))).where(F.col("similarity") >= threshold)
    return names.join(scored.select("name", "distance", "similarity"), "name")


def search_batch(names: DataFrame, queries: DataFrame, threshold: float = 0.85, numeric_weight: int = 0, index: DataFrame | None = None) -> DataFrame:
    """(q_idx, q, and the columns of names): the same for each of queries(q_idx, q), which are joined by length.

    Different names and different queries are compared once each; lengths in proportion are the join keys.
    """
    each = indexed(names.select("name").distinct()) if index is None else index
    asked = indexed(queries.select(F.col("q").alias("name")).distinct()).select(F.col("name").alias("q"), F.col("glen").alias("qlen"), F.col("plain").alias("qplain"))
    # A query of n graphemes meets lengths n * t to n / t.
    reach = F.sequence(F.ceil(F.col("qlen") * threshold - 1e-9).cast("int"), F.floor(F.col("qlen") / threshold + 1e-9).cast("int"))
    asked = asked.withColumn("glen", F.explode(reach))
    pairs = each.join(asked, "glen")
    allowed = most_edits(threshold, F.greatest("glen", "qlen"))
    lev = F.levenshtein("plain", "qplain")
    near = pairs.where(F.col("plain").isNull() | F.col("qplain").isNull() | (lev <= 2 * allowed))
    scored = near.withColumn("distance", damerau_distance(F.col("name"), F.col("q"), numeric_weight))
    scored = scored.withColumn("similarity", from_distance(F.col("distance"), F.col("glen"), F.col("qlen"))).where(F.col("similarity") >= threshold)
    return names.join(scored.select("q", "name", "distance", "similarity"), "name").join(queries, "q")
