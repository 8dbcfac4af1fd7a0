"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamiz.llm import decontam, langid, licenses, linededup, mixing, mtree, simhash, tokencounts, toxicity, warc
from tamiz.llm.common import shared_dir, table


def op1_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.query(table(spark, sf_dir, "embeddings"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.query(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.query(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.query(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mtree, op2_decontamination, op3_toxicity, op4_warc_fixity, op5_line_dedup,
        op6_simhash, op7_language_id, op8_mixing, op9_licenses, op10_token_counts,
    )
}

SQL: dict[str, str] = {"op1_mtree": mtree.SQL, "op4_warc_fixity": warc.SQL}
