"""Text normalisers and tokenisers, as functions from Column to Column."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions.once import let

# Stop-words of the word tokeniser.
STOP_WORDS = (
    "el la los las un una unos unas lo al del a e o y de en con por para que es su se no si le yo tu él ella nos vos ellos ellas"
).split()

# The phonetic normaliser's plain letters, and the accented ones that stand for each.
PLAIN = {"a": "áàâãäåæ", "e": "éèêë", "i": "íìîï", "o": "óòôõöø", "u": "úùûü", "c": "ç"}


def _form(name: str):
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unicodedata.normalize(name, x))

    return normal


def _only_beyond_ascii(c: Column, name: str) -> Column:
    """Unicode normal form. Text of ASCII alone is its own: the UDF is given a null in its place."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.coalesce(_form(name)(F.when(~plain, c)), c)


def nfc(c: Column) -> Column:
    return _only_beyond_ascii(c, "NFC")


def nfd(c: Column) -> Column:
    return _only_beyond_ascii(c, "NFD")


def graphemes(c: Column) -> Column:
    """Extended grapheme clusters, in order."""
    return F.regexp_extract_all(c, F.lit(r"\X"), F.lit(0))


def preprocess(c: Column) -> Column:
    """What edit distances compare: the grapheme clusters of the composed, lower-cased text."""
    return graphemes(F.lower(nfc(c)))


def is_numeric_ascii(c: Column) -> Column:
    return c.rlike(r"\A[0-9]\z")


def is_alphabetic_ascii(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z]\z")


def normalize_sku(c: Column) -> Column:
    """A code without hyphens and white space; letter case stays."""
    return F.regexp_replace(c, r"(?U)[-\s]", "")


def normalize_phonetic(c: Column) -> Column:
    """Lower-case a-z and 0-9 only: accents off, ñ as ny, ß as ss, everything else gone, spaces too."""
    c = F.regexp_replace(F.lower(c), "ñ|ñ", "ny")
    c = F.regexp_replace(c, "ß", "ss")
    c = F.translate(c, "".join(PLAIN.values()), "".join(k * len(v) for k, v in PLAIN.items()))
    return F.regexp_replace(c, "[^a-z0-9]", "")


def normalize_phonetic_upper(c: Column) -> Column:
    return F.upper(normalize_phonetic(c))


def word_tokens(c: Column) -> Column:
    """Words of the decomposed text without stop-words, repeats kept. Marks part words and letter case counts, so a
    decomposed accent ends a word and an upper-case stop-word is one of the words."""
    words = F.regexp_extract_all(nfd(c), F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def bigram_shingles(c: Column) -> Column:
    """The set of pairs of neighbouring graphemes; empty below two of them. Letter case counts."""

    def pairs(g: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(g) - 2), lambda i: F.concat(F.get(g, i), F.get(g, i + 1)))
        return F.when(F.size(g) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(each))

    return let(graphemes(c), pairs)
