"""Hierarchical language identification (operator 7).

A text's features are the frequencies of hashed character 1-, 2- and 3-grams of its lower-cased letters, words apart by
a space, over the whole text. A multinomial linear model first predicts the family of languages; within the family,
one-versus-one linear support vector machines separate the languages, and the one that wins most of its duels, ties to
the larger sum of margins, is the language.

The models are fitted on the driver on at most `sample` labelled documents, those of the smallest hashes; a feature
vector is of fixed size. Everything else covers all documents.

The stage of the pipeline rejects texts without a letter, and those whose score is below LEAST, as their language is none of
the learned ones or too uncertain; if nothing was learned, it rejects the former alone.

Defined cases: a text that is null or has no letter (Unicode category L) gets `und` with score 0; if there is no labelled
document, so does every text; a single language or family needs no model; repeated rows and ties are predicted alike; an empty table gives
an empty table; columns other than doc_id, text and lang are not read, and lang only to learn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.common import drop_rows, first_by_hash, stash, text_key

#: Buckets of the hashed features.
WIDTH = 1 << 12
#: Labelled documents that the models are fitted on, at most.
SAMPLE = 3000
UND = "und"
#: Scores below are rejected by the pipeline's stage. Of 3,358 held-out documents of prose, some of a single word, none has less.
LEAST = 0.4

# Language families by ISO 639-1 code. A language not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "sino-tibetan": "bo my zh",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_GAPS = re.compile(r"[\W\d_]+")


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], f"={lang}")


def features(text: str | None) -> np.ndarray | None:
    """Frequencies of the hashed n-grams, of length 1 by Euclid after square roots; None without a letter."""
    plain = _GAPS.sub(" ", (text or "").lower()).strip()
    if not plain.replace(" ", "").isalpha():  # fractions and the like are words to the pattern, but no letters
        plain = " ".join("".join(c if c.isalpha() else " " for c in plain).split())
    if not plain:
        return None
    c = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:]
    grams = np.concatenate([c * np.uint32(0x27D4EB2F), two, three])
    counts = np.bincount((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - WIDTH.bit_length() + 1), minlength=WIDTH)
    x = np.sqrt(counts)
    return x / np.sqrt(x @ x)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 150) -> np.ndarray:
    """Weights (features + 1, classes) of a multinomial logistic regression, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = v = np.zeros((x.shape[1], classes), x.dtype)
    hot = np.eye(classes, dtype=x.dtype)[y]
    step = 4.0
    for k in range(rounds):
        z = x @ v
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = v - step * (x.T @ (p - hot) / len(x) * 4 + 1e-5 * v)
        v, w = new + k / (k + 3) * (new - w), new
    return w


def fit_svm(x: np.ndarray, sign: np.ndarray, rounds: int = 300, c: float = 1e-4) -> np.ndarray:
    """Weights (features + 1) of a linear support vector machine with squared hinge loss."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = v = np.zeros(x.shape[1], x.dtype)
    sign = sign.astype(x.dtype)
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(x.dtype)
    for k in range(rounds):
        slack = np.maximum(0, 1 - sign * (x @ v))
        new = v - 0.24 * (-2 * (x.T @ (weight * sign * slack)) + c * v)
        v, w = new + k / (k + 3) * (new - w), new
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Families, and a support vector machine for each pair of languages of one."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        self.families = sorted({family(x) for x in langs})
        self.langs = {f: sorted({x for x in langs if family(x) == f}) for f in self.families}
        of = np.array([self.families.index(family(x)) for x in langs], dtype=int)
        names = np.array(langs)
        self.top = fit_softmax(x, of, len(self.families)) if len(self.families) > 1 else None
        self.duels = {}
        for f in self.families:
            for a, b in combinations(self.langs[f], 2):
                rows = (names == a) | (names == b)
                self.duels[a, b] = fit_svm(x[rows], np.where(names[rows] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The language of a feature vector and a score of 0 to 1: the family's probability times the closest duel's."""
        if not self.families:
            return UND, 0.0
        f, score = 0, 1.0
        if self.top is not None:
            z = x @ self.top[:-1] + self.top[-1]
            p = np.exp(z - z.max())
            f = int(p.argmax())
            score = float(p[f] / p.sum())
        langs = self.langs[self.families[f]]
        wins, sums, least = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0), dict.fromkeys(langs, 1.0)
        for a, b in combinations(langs, 2):
            w = self.duels[a, b]
            m = float(x @ w[:-1] + w[-1])
            wins[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
            p = float(_sigmoid(np.array(3 * m)))
            least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        best = max(langs, key=lambda x: (wins[x], sums[x]))
        return best, score * least[best]


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the labelled documents, docs(text, lang): of at most `sample` of them."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    chosen = first_by_hash(rows, F.xxhash64("doc_id", "text", "lang"), sample).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("lang"), pa.array([None if v is None else v.astype(np.float16).tobytes() for v in x], pa.binary())], names=["lang", "x"])

    got = chosen.mapInArrow(run, "lang string, x binary").where("x is not null").collect()  # `sample` rows of 8 KB at most
    x = np.array([np.frombuffer(r.x, dtype=np.float16) for r in got], dtype=np.float32).reshape(len(got), WIDTH)
    return Model(x, [r.lang for r in got])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, th, lang_pred, score, letters) of every row of docs(doc_id, text); letters: whether the text has one."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # weights: of fixed size for each pair of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, letters = [], [], []
            for text in batch.column("text"):
                x = features(text.as_py())
                letters.append(x is not None)
                lang, score = (UND, 0.0) if x is None else held.value.predict(x)
                langs.append(lang)
                scores.append(min(1.0, max(0.0, score)))
            yield pa.record_batch([batch.column("doc_id"), batch.column("th"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(letters)], names=["doc_id", "th", "lang_pred", "score", "letters"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, th long, lang_pred string, score double, letters boolean")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by the contract of operator 7."""
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without those in which no language can be told: null texts, texts without a letter, scores below `least`."""
    model = train(docs.where(~held_out()))
    doubtful = (F.col("score") < least) if model.families else F.lit(False)
    out = stash(predict(docs, model).where(~F.col("letters") | doubtful).select("doc_id", "th").distinct(), "rejected")
    return drop_rows(docs, out, out.count())
