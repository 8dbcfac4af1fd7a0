"""Cleans and mixes the documents in five stages, each an operator of tamiz.llm.

Defined cases, for every stage: null, empty and blank texts, null ids, languages and sources, and further columns of any
name are no error; an empty table gives an empty one. Language ID rejects null texts and texts without a letter; the other
stages keep an empty text once. Repeated rows are one document to line dedup and decontamination, and one of them is left by
near-dedup. All but the last stage return the columns of the documents, in their order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamiz.llm import decontam, langid, linededup, mixing, neardup
from tamiz.llm.common import remove, scope, shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose language is predicted with too low a score."""
    return langid.accepted(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within two edits of an earlier line go, and documents of which nothing is left."""
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, linked by SimHash or by a similarity of 0.8 of their five-word shingles."""
    return neardup.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: (shard, slot, start, doc_id, source, words), the pieces of text in each slot of each output shard."""
    return mixing.mixed_texts(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
]

#: Hashes and trained models have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each one's result is written to the shared folder and read again, and what it is
    made of is removed from there."""
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        if before:
            remove(spark, before)
        before = f"{base}/{k}"
        docs = spark.read.parquet(before)
    return docs
