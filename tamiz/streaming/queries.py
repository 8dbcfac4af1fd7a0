"""A stream of queries over a static catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tamiz.plans.search import LIMIT, Algorithm, search_batch
from tamiz.sources.catalog import Catalog


def answer(stream: DataFrame, catalog: Catalog, algorithm: Algorithm, sink: Callable[[DataFrame, int], None], checkpoint: str, limit: int = LIMIT) -> StreamingQuery:
    """Answers each micro-batch of stream(q_idx, q) with search_batch() and hands the result to sink(df, batch id).

    Queries that come while a batch runs wait for the next one. A batch that fails is given again with the same id, so a
    sink that writes by id is exact.
    """
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(search_batch(catalog, df, algorithm, limit), n)).start()
