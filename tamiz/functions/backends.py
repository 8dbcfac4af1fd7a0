"""What searches may be given in place of their own parts: encoders of sounds, embeddings, edit metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions import kernels, phonetic


@dataclass(frozen=True)
class Encoder:
    """A phonetic encoder: a string's primary and secondary code."""

    encode: Callable[[str], tuple[str, str]] = phonetic.encode

    def codes(self, c: Column) -> Column:
        """Struct (pri, sec) of a string column."""
        if self.encode is phonetic.encode:
            return phonetic.codes(c)
        encode = self.encode

        @F.pandas_udf("struct<pri: string, sec: string>")
        def run(s: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([encode(x) for x in s], columns=["pri", "sec"])

        return run(F.coalesce(c, F.lit("")))


@dataclass(frozen=True)
class Embedding:
    """An embedding backend: the vectors of some texts, a row for each."""

    vectors: Callable[[list[str]], np.ndarray] = kernels.mock_vectors

    def of(self, c: Column) -> Column:
        vectors = self.vectors

        @F.pandas_udf("array<float>")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series(list(np.asarray(vectors([x or "" for x in s]), dtype=np.float32)))

        return run(c)


#: A distance of two strings as lists of graphemes, composed and lower-cased.
Metric = Callable[[list[str], list[str]], int]


def distance(metric: Metric, a: Column, b: Column) -> Column:
    """The distance of two string columns by a metric."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = [None if x is None or y is None else metric(kernels.prepared(x), kernels.prepared(y)) for x, y in zip(a, b, strict=True)]
        return pd.Series(out, dtype="Int32")

    return run(a, b)
