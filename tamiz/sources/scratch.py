"""A folder that all executors share, for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; in a local one only where none is set and all is on one machine, as
    in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tamiz-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: While a table is written: rows of a batch that goes to Python, and whether the write's shuffle files go as soon as it ends.
_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Settings for what is written or fetched within, of which no shuffle file is needed later."""
    before = {k: spark.conf.get(k) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: it is made once, a lost executor loses nothing of it, and no
    shuffle file of it is left."""
    path = scratch(df.sparkSession, name)
    with writing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
