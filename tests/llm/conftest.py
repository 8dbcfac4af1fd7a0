import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))  # for oracle.py

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp int, seed string, p int, size int, k int, th int, pos int, line string, score double, block int"


def rows_of(texts, lang="en", source="a"):
    """Rows of the documents' columns and of some whose names the operators use themselves."""
    return [(i, t, lang, source, len(t or ""), 1, "x", 2, 3, 4, 5, 6, "y", 0.5, 7) for i, t in texts]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows, ties, other scripts, clashing columns."""
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "über", "ñandú", "日本", "😀"]
    long = " ".join(rnd.choice(words) + str(rnd.randint(0, 999)) for _ in range(15_000))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, long), (6, "the same row again and again " * 3), (6, "the same row again and again " * 3)]
    texts += [(7, "the same row again and again " * 3), (8, "你好 世界 再见"), (9, "1234 5678 !!"), (None, "a row without an id that is long enough to be a line"), (10, "\n".join(["one line that is long enough"] * 4)), (11, "MIT License")]
    rows = rows_of(texts)
    rows[3] = (*rows[3][:2], None, None, *rows[3][4:])
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, **kw: spark.createDataFrame(rows_of(texts, **kw), SCHEMA)


@pytest.fixture
def plans(monkeypatch):
    """plans(module, make): the plans of all tables that a module writes on the way to make(), and of that."""

    def all_of(module, make):
        seen, real = [], module.stash

        def noted(df, *args, **kw):
            seen.append(df._jdf.queryExecution().toString())
            return real(df, *args, **kw)

        monkeypatch.setattr(module, "stash", noted)
        return [make()._jdf.queryExecution().toString(), *seen]

    return all_of
