"""The measures as SQL functions, for spark.sql()."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tamiz.functions import kernels, phonetic


def register(spark: SparkSession) -> list[str]:
    """Registers the kernels that SQL lacks, and returns the names. Measures that SQL can write are SQL functions, which
    the optimizer sees through."""

    @F.pandas_udf("double")
    def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else kernels.jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    @F.pandas_udf("int")
    def true_damerau(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else kernels.true_damerau(kernels.prepared(x), kernels.prepared(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")

    @F.pandas_udf("string")
    def phonetic_primary(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else phonetic.encode(x)[0])

    @F.pandas_udf("string")
    def phonetic_secondary(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else phonetic.encode(x)[1])

    udfs = {"jaro_winkler": jaro_winkler, "true_damerau": true_damerau, "phonetic_primary": phonetic_primary, "phonetic_secondary": phonetic_secondary}
    for name, f in udfs.items():
        spark.udf.register(name, f)
    written = {
        "hamming_words(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS INT": "CASE WHEN size(a) = size(b) THEN aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0, (s, d) -> s + d) END",
        "dice_similarity(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(a) + size(b) > 0 THEN 2.0D * size(array_intersect(a, b)) / (size(a) + size(b)) ELSE 0.0D END",
        "dot_product(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "CASE WHEN size(a) = size(b) THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, d) -> s + d) END",
    }
    for signature, body in written.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [*udfs, *(s.split("(")[0] for s in written)]
