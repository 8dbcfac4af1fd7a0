"""Spanish-adapted Double Metaphone codes: a rule table over the phonetic normal form."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tamiz.functions.text import PLAIN, normalize_phonetic_upper

# Fixed values: (what a rule consumes, primary code, secondary code), the first that fits wins. \A is the word's start.
RULES = [
    (r"\A[AEIOU]", "A", "A"), (r"[AEIOU]", "", ""),
    (r"Y[AEIOU]", "Y", "Y"), (r"Y", "", ""),
    (r"BB?", "P", "P"), (r"VV?", "P", "P"),
    (r"(?<=S)C(?=[EIY])", "", ""), (r"CIA", "X", "X"), (r"C[EIY]", "S", "X"), (r"\ACH", "K", "X"), (r"(?<=S)CH", "X", "K"), (r"CH", "K", "K"), (r"CC[EIY]", "KS", "KS"), (r"CC?", "K", "K"),
    (r"DG[EIY]", "J", "J"), (r"DD?", "T", "T"),
    (r"FF?", "F", "F"), (r"KK?", "K", "K"), (r"QQ?", "K", "K"),
    (r"GH(?=[AEIOUY])", "K", "K"), (r"GH", "", ""), (r"GN", "N", "N"), (r"G[EIY]", "J", "K"), (r"G[AOU]", "K", "K"), (r"GG?", "K", "K"),
    (r"\AH[AEIOU]", "A", "A"), (r"H", "", ""),
    (r"J+", "J", "J"), (r"Z+", "S", "S"),
    (r"LL", "Y", "L"), (r"L", "L", "L"), (r"M", "M", "M"), (r"N", "N", "N"), (r"R", "R", "R"),
    (r"PH", "F", "F"), (r"P", "P", "P"),
    (r"SH", "X", "X"), (r"SI[AO]", "X", "X"), (r"\ASW", "S", "X"), (r"S", "S", "S"),
    (r"TH", "0", "T"), (r"TI[AO]", "X", "X"), (r"TCH", "X", "X"), (r"TT?", "T", "T"),
    (r"WH[AEIOU]", "A", "A"), (r"WH", "A", "F"), (r"\AW[AEIOU]", "A", "A"), (r"WI(?=[CT])", "A", "A"), (r"W", "F", "F"),
    (r"\AX", "S", "S"), (r"X", "KS", "KS"),
]
#: Starts of a word whose first letter is silent.
SILENT = re.compile(r"(?=GN|KN|PN|WR)")
LONGEST = 8

#: All rules at once; the number of the group that took part is the rule's.
_ANY = re.compile("|".join(f"({pattern})" for pattern, _, _ in RULES))

_FOLD = str.maketrans({ch: plain for plain, many in PLAIN.items() for ch in many} | {"ñ": "ny", "ß": "ss"})


def normalized(s: str) -> str:
    """The same as functions.text.normalize_phonetic_upper."""
    s = re.sub("\u00f1|n\u0303", "ny", s.lower()).translate(_FOLD)
    return re.sub("[^a-z0-9]", "", s).upper()


def encode(s: str, most: int = 6) -> tuple[str, str]:
    """Primary and secondary code of a string, of at most `most` letters each."""
    word = normalized(s)
    at = 1 if SILENT.match(word) else 0
    pri = sec = ""
    while at < len(word) and len(pri) < most:
        m = _ANY.match(word, at)  # digits have no rule
        if m:
            _, p, q = RULES[m.lastindex - 1]
            pri, sec = (pri + p)[:most], (sec + q)[:most]
        at = m.end() if m else at + 1
    return pri, sec


def codes(c: Column, most: int = 6) -> Column:
    """Struct (pri, sec) of a string column."""
    if not 0 < most <= LONGEST:
        raise ValueError(f"a code has 1 to {LONGEST} letters")

    @F.pandas_udf("struct<pri: string, sec: string>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([encode(x, most) for x in s], columns=["pri", "sec"])

    return run(normalize_phonetic_upper(F.coalesce(c, F.lit(""))))


def variants(code: str, distance: int) -> dict[str, int]:
    """Codes within this many edits of a code, other than itself, with their distance: a letter less, changed, more (below
    ten letters), or two neighbours swapped. No edit brings in the digit 0 of the th sound."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    seen, edge = {code: 0}, [code]
    for d in range(1, distance + 1):
        ring = []
        for c in edge:
            near = [c[:i] + c[i + 1 :] for i in range(len(c))]
            near += [c[:i] + x + c[i + 1 :] for i in range(len(c)) for x in letters]
            near += [c[:i] + x + c[i:] for i in range(len(c) + 1) for x in letters if len(c) < 10]
            near += [c[:i] + c[i + 1] + c[i] + c[i + 2 :] for i in range(len(c) - 1)]
            for v in near:
                if v not in seen:
                    seen[v] = d
                    ring.append(v)
        edge = ring
    del seen[code]
    return seen

