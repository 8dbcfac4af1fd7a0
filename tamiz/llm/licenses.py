"""License scans: fuzzy search for short notices (operator 9).

Words are runs of ASCII digits, A-Z lower-cased, a-z and characters beyond ASCII; a notice and a text are their words
joined by single spaces. A notice of n characters may have up to n // `per_error` errors (insertions, deletions and
substitutions of characters): cut into one piece more than errors, one piece stands exactly in every match. An
Aho-Corasick automaton of all pieces passes over the whole text; around each piece found, the regex library's
bounded-error matching verifies the notice, and reports the span and the errors.

Besides, the base phrases are found where their words stand consecutively; their labels are always among the labels.

Defined cases: null, empty and word-free texts have no place, null first and last words and score 0; repeated rows are
scanned alike; of overlapping matches of a notice the one of the fewest errors, then the first, is kept; an empty table
gives an empty table; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and labels of the base search.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Openings of well-known public licenses and notices, by label.
NOTICES = {
    "apache": ["licensed under the apache license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd license"],
    "cc-by": ["licensed under cc by 4 0", "licensed under a creative commons attribution 4 0"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike"],
    "cc0": ["to the extent possible under law the author has waived all copyright"],
    "gpl": ["licensed under the gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license"],
    "lgpl": ["licensed under the gnu lesser general public license"],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software", "released under the mit license"],
    "mpl": ["subject to the terms of the mozilla public license"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "all-rights-reserved": ["all rights reserved no part of this"],
}
#: Characters of a notice for each error that it may have.
PER_ERROR = 12

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Scanner:
    """The automaton of all pieces, and a bounded-error pattern for each notice."""

    def __init__(self, notices: dict[str, list[str]] = NOTICES, per_error: int = PER_ERROR) -> None:
        self.notices = [(label, text, len(text) // per_error) for label, texts in sorted(notices.items()) for text in texts]
        self.patterns = [regex.compile(rf"(?be)(?:{regex.escape(t, literal_spaces=True)}){{e<={k}}}") for _, t, k in self.notices]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, k) in enumerate(self.notices):
            cuts = [round(len(text) * j / (k + 1)) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def fuzzy(self, joined: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, errors) of the verified matches in joined words."""
        windows: dict[int, list[list[int]]] = {}
        for end, (n, where) in self.automaton.iter(joined) if len(self.automaton) else ():
            for i, offset in where:
                _, text, k = self.notices[i]
                low = max(0, end + 1 - n - offset - k)
                high = min(len(joined), end + 1 - n - offset + len(text) + k)
                own = windows.setdefault(i, [])
                if own and low <= own[-1][1] and high - own[-1][0] <= 4 * len(text):  # hits come in order of their ends
                    own[-1][0], own[-1][1] = min(low, own[-1][0]), max(high, own[-1][1])
                else:
                    own.append([low, high])
        found = []
        for i, spans in windows.items():
            label, _, k = self.notices[i]
            best: list[tuple[int, int, int]] = []
            shortest = len(self.notices[i][1]) - k
            while spans:  # the best match of a span first, then what is left before and behind it
                low, high = spans.pop()
                if high - low >= shortest and (m := self.patterns[i].search(joined, low, high)):
                    best.append((sum(m.fuzzy_counts), m.start(), m.end()))
                    spans += [[low, m.start()], [max(m.end(), m.start() + 1), high]]
            kept: list[tuple[int, int, int]] = []
            for e, a, b in sorted(best):
                if all(b <= x or a >= y for _, x, y in kept):
                    kept.append((e, a, b))
            found += [(label, a, b, e) for e, a, b in kept]
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, int, int]]]:
        """Number of words; (label, word) of base places; (label, first word, last word, errors, length) of matches."""
        words = words_of(text)
        joined = b" ".join(words)
        lined = b" " + joined + b" "
        base = []
        for phrase, label in BASE.items():
            wanted, at, word = b" " + phrase.encode() + b" ", -1, 0
            while (here := lined.find(wanted, at + 1)) >= 0:
                word += lined.count(b" ", max(at, 0), here)
                base.append((label, word))
                at = here
        decoded = joined.decode("utf-8", "replace")
        found = self.fuzzy(decoded)
        gaps = [i for i, c in enumerate(decoded) if c == " "] if found else []
        matches = [(label, bisect_left(gaps, a + (decoded[a : a + 1] == " ")), bisect_left(gaps, max(a, b - 1)), e, b - a) for label, a, b, e in found]
        return len(words), sorted(base, key=lambda x: (x[1], x[0])), matches


SPANS = "doc_id long, n_words long, base array<struct<label: string, word: long>>, matches array<struct<label: string, first: long, last: long, errors: int, length: int>>"


def scan(docs: DataFrame, notices: dict[str, list[str]] = NOTICES, per_error: int = PER_ERROR) -> DataFrame:
    """(doc_id, n_words, base, matches) of every document: spans are in words from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, per_error)
        base_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
        match_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("errors", pa.int32()), ("length", pa.int32())]))
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column("text")]
            base = [[{"label": a, "word": w} for a, w in r[1]] for r in rows]
            matches = [[{"label": a, "first": f, "last": z, "errors": e, "length": n} for a, f, z, e, n in r[2]] for r in rows]
            yield pa.record_batch([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array(base, base_type), pa.array(matches, match_type)], names=["doc_id", "n_words", "base", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SPANS)


def query(docs: DataFrame) -> DataFrame:
    """A row for each document, by the contract of operator 9; score is 1 with a base place, else that of the best match."""
    names = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda x: x["label"]) for c in cols]))), ",")
    starts = F.transform("base", lambda x: x["word"])
    near = F.array_max(F.transform("matches", lambda x: 1 - x["errors"] / F.greatest(x["length"], F.lit(1))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.coalesce(near, F.lit(0.0))))
    return scan(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names("base").alias("base_labels"), names("base", "matches").alias("labels"), score.alias("score"), F.size("matches").cast("long").alias("n_fuzzy"),
    )
