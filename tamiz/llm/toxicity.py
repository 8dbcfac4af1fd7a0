"""Toxicity by a weighted finite-state pattern grammar (operator 3).

A text is cut into clauses, and a clause into words, each of a class: insult, violence, stress, intent, target (a person
spoken to or of), negation, reported speech, or other. Five weighted transducers rewrite the words one after the other:

* insult marks an insulting word, with a further weight behind a word of stress;
* threat marks a word of violence, with a further weight if the clause has spoken of an intent;
* reported speech marks what follows it in the clause as reported;
* negation marks the next insult or threat as denied, and a second negation takes the first back;
* target marks insults and threats behind a target as aimed, or the last one before it.

Each has its weights on its arcs. The five are composed into one machine, which runs over the words of each clause that has
an insult or a violent word; the clause's weight is the sum along its path. A text's score is the logistic of the bias and
its clauses' weights, in which the uses of an arc weight count by logarithm. Words alone have no weight.

The lexicon has a small list, and what is learned from labelled texts: beginnings of words, and whole words of two and three
letters, that so many toxic texts have that it can't be by chance, and that few other texts have, counted over all labelled
documents; of toxic near copies, those that share one of 32 MinHash values of word triples, the first counts. What stands
behind an intent in most of its places is learned as violence, else as an insult. Counts of toxic and other texts are joined
before the driver sees any, and all that pass are kept. The arcs' weights are fitted on the driver on at most `sample`
labelled documents, those of the smallest hashes.

Defined cases: null, empty and word-free texts match no clause and get the bias alone; without labels of both kinds the
listed words and set weights decide; repeated rows are scored alike; labels of a document that disagree each count;
an empty table gives an empty table; of the documents only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.common import first_by_hash, maybe_broadcast, stash
from tamiz.llm.simhash import shingle_digests

#: Labelled documents that the weights are fitted on, at most; lengths of the beginnings of words.
SAMPLE = 20_000
SHORTEST, LONGEST = 4, 8

# The listed words of each class, of English, German, French and Spanish; the first two are beginnings.
INSULTS = "idiot moron stupid scum loser worthless pathetic disgusting trash clown arschloch dummkopf connard salaud imbécile estúpido cabrón"
VIOLENCE = "kill hurt destroy murder umbringen töten tuer frapper matar"
STRESS = "so such very really total totally utter complete absolute sehr völlig total vraiment tellement muy tan completamente"
INTENT = "will gonna going i'll we'll shall should werde werden sollte vais allons voy vamos"
TARGETS = "you your yours he she him her you're he's she's they them these those du dich ihr euch sie tu vous toi ils elles tú usted ustedes ellos ellas"
NEGATIONS = "not no never nobody isn't aren't wasn't don't doesn't won't nicht kein keine nie pas jamais aucun nunca jamás ningún"
REPORTS = "said says told reported quoted claimed called according sagte sagt laut berichtete dit selon déclaré dijo dice según"

OTHER, INSULT, VIOLENT, STRESSED, INTENDED, TARGET, NEGATION, REPORT = range(8)
CLAUSES = re.compile(r"[.!?;:\n\r()\"“”«»|]+")
WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")

#: What a word has been marked as.
IS_INSULT, IS_THREAT, IS_REPORTED, IS_DENIED = 1, 2, 4, 8
#: The arcs' weights by name, as they are set before any is fitted, and the bias. Denied and reported ones take away.
ARCS = {"insult": 5.0, "stressed insult": 0.5, "threat": 5.0, "intended threat": 1.0, "aimed insult": 0.5, "aimed threat": 1.0, "denied": -4.5, "reported": -4.0}
BIAS = -3.0
_ARC = {name: i for i, name in enumerate(ARCS)}

#: A symbol is a word's class and marks; a machine's state and a symbol give a state, a symbol, and the weights of the arc.
Symbol = tuple[int, int]
Arc = tuple[int, Symbol, tuple[str, ...]]


class Transducer:
    """A deterministic weighted machine that rewrites symbols; state 0 is where a clause begins."""

    def __init__(self, table: dict[tuple[int, Symbol], Arc]) -> None:
        self.table = table

    @classmethod
    def of(cls, states: int, step: Callable[[int, int, int], Arc]) -> Transducer:
        """The machine of a step: state, class and marks to an arc."""
        return cls({(s, (c, marks)): step(s, c, marks) for s in range(states) for c, marks in product(range(8), range(16))})

    def compose(self, after: Transducer) -> Transducer:
        """The machine that does what this one does, then what `after` does with its output; an arc has both arcs' weights."""
        states, table, todo = {(0, 0): 0}, {}, [(0, 0)]
        symbols = {s for _, s in self.table}
        while todo:
            a, b = todo.pop()
            for s in symbols:
                x, between, one = self.table[a, s]
                y, out, two = after.table[b, between]
                if (x, y) not in states:
                    states[x, y] = len(states)
                    todo.append((x, y))
                table[states[a, b], s] = (states[x, y], out, one + two)
        return Transducer(table)


def insulting() -> Transducer:
    def step(state: int, c: int, marks: int) -> Arc:
        if c == INSULT:
            return 0, (c, marks | IS_INSULT), ("insult", "stressed insult") if state else ("insult",)
        return int(c == STRESSED), (c, marks), ()

    return Transducer.of(2, step)


def threatening() -> Transducer:
    def step(state: int, c: int, marks: int) -> Arc:
        if c == VIOLENT:
            return state, (c, marks | IS_THREAT), ("threat", "intended threat") if state else ("threat",)
        return int(state or c == INTENDED), (c, marks), ()

    return Transducer.of(2, step)


def reporting() -> Transducer:
    def step(state: int, c: int, marks: int) -> Arc:
        if state and marks & (IS_INSULT | IS_THREAT):
            return 1, (c, marks | IS_REPORTED), ("reported",)
        return int(state or c == REPORT), (c, marks), ()

    return Transducer.of(2, step)


def negating() -> Transducer:
    """What is reported needs no denial: its negation is used up without a weight."""

    def step(state: int, c: int, marks: int) -> Arc:
        if c == NEGATION:
            return 1 - state, (c, marks), ()
        if state and marks & (IS_INSULT | IS_THREAT):
            return 0, (c, marks | IS_DENIED), () if marks & IS_REPORTED else ("denied",)
        return state, (c, marks), ()

    return Transducer.of(2, step)


def targeting() -> Transducer:
    """States: nothing yet, a target, an insult or a threat that waits for one. Only what is meant is aimed."""

    def step(state: int, c: int, marks: int) -> Arc:
        meant = not marks & (IS_REPORTED | IS_DENIED)
        kind = 2 if marks & IS_INSULT and meant else 3 if marks & IS_THREAT and meant else 0
        names = ("", "", "aimed insult", "aimed threat")
        if c == TARGET:
            return 1, (c, marks), (names[state],) if state > 1 else ()
        if kind and state == 1:
            return 1, (c, marks), (names[kind],)
        return kind or state, (c, marks), ()

    return Transducer.of(4, step)


def grammar() -> Transducer:
    return insulting().compose(threatening()).compose(reporting()).compose(negating()).compose(targeting())


class Lexicon:
    """Classes of words: whole words, and beginnings of insults and of words of violence."""

    def __init__(self, learned: dict[str, int] | None = None) -> None:
        self.words: dict[str, int] = {}
        for listed, c in ((STRESS, STRESSED), (INTENT, INTENDED), (REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET)):
            self.words |= dict.fromkeys(listed.split(), c)
        learned = learned or {}
        self.words |= {s[:-1]: c for s, c in learned.items() if s.endswith("$") and s[:-1] not in self.words}
        self.stems = {s: c for s, c in learned.items() if not s.endswith("$")}
        self.stems |= dict.fromkeys(INSULTS.split(), INSULT) | dict.fromkeys(VIOLENCE.split(), VIOLENT)
        self.lengths = sorted({len(s) for s in self.stems})
        self.heads = {s[:SHORTEST] for s in self.stems}
        self.short = {w for w, c in self.words.items() if c in (INSULT, VIOLENT)}

    def may(self, words: set[str]) -> bool:
        """Whether some word may be an insult or one of violence."""
        return not self.short.isdisjoint(words) or any(w[:SHORTEST] in self.heads for w in words)

    def of(self, word: str) -> int:
        if word in self.words:
            return self.words[word]
        if word[:SHORTEST] in self.heads:
            for n in self.lengths:
                if n <= len(word) and word[:n] in self.stems:
                    return self.stems[word[:n]]
        return OTHER


def matched(text: str | None, lexicon: Lexicon, machine: Transducer) -> list[tuple[int, int, np.ndarray]]:
    """(start, end, uses of each arc weight) of the clauses of a text, lower-cased, that have an insult or a threat."""
    low = (text or "").lower()
    if not lexicon.may(set(WORDS.findall(low))):
        return []
    out, start = [], 0
    for end, after in [*(m.span() for m in CLAUSES.finditer(low)), (len(low), len(low))]:
        classes = [lexicon.of(w) for w in WORDS.findall(low[start:end])]
        if INSULT in classes or VIOLENT in classes:
            uses, state = np.zeros(len(ARCS)), 0
            for c in classes:
                state, _, names = machine.table[state, (c, 0)]
                for name in names:
                    uses[_ARC[name]] += 1
            out.append((start, end, uses))
        start = after
    return out


def features(text: str | None, lexicon: Lexicon, machine: Transducer) -> np.ndarray:
    return np.log1p(sum((uses for _, _, uses in matched(text, lexicon, machine)), np.zeros(len(ARCS))))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the labelled documents that may be learned from."""
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("l"), F.col("toxic").cast("int").alias("toxic"))
    texts = docs.where(~held_out()).select(F.col("doc_id").cast("long").alias("d"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(maybe_broadcast(known, known.count()), F.col("d") == F.col("l")).select(F.col("d").alias("doc_id"), "text", "toxic")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Places of a word, and those of them behind an intent.
_BEHIND = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(map(re.escape, INTENT.split()))})\s+(?:to\s+)?(?=[^\W\d_])")


def beginnings(rows: DataFrame) -> DataFrame:
    """(stem, n, meant): in how many texts of rows(text) a word begins so, or is so and ends ("$") within three letters; and
    in how many of them it stands behind an intent."""

    def stems(words: set[str]) -> set[str]:
        long = {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}
        return long | {w + "$" for w in words if 1 < len(w) < SHORTEST}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            meant: Counter[str] = Counter()
            for text in batch.column("text"):
                low = text.as_py().lower()
                counts.update(stems(set(WORDS.findall(low))))
                meant.update(stems({WORDS.match(low, m.end()).group() for m in _BEHIND.finditer(low)}))
            yield pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64()), pa.array([meant[s] for s in counts], pa.int64())], names=["stem", "n", "meant"])

    return rows.select("text").mapInArrow(run, "stem string, n long, meant long").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("meant").alias("meant"))


def one_of_near_copies(rows: DataFrame, sketches: int = 32) -> DataFrame:
    """rows(text) without those with which an earlier one, by the hash of the text, shares a MinHash value."""
    odd = np.arange(1, 2 * sketches, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text"):
                h = np.frombuffer(b"".join(shingle_digests(text.as_py(), 3)), dtype=np.uint64)
                found.append([int((h * k).min()) >> 1 for k in odd] if len(h) else [0] * sketches)
            yield pa.record_batch([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "g"])

    known = rows.select(F.xxhash64("text").alias("id"), "text")
    each = known.mapInArrow(run, "id long, g array<long>").distinct().select("id", F.posexplode("g").alias("i", "g"))
    first = each.groupBy("i", "g").agg(F.min("id").alias("first"))
    later = each.join(first, ["i", "g"]).where("id > first").select("id").distinct()
    return known.dropDuplicates(["id"]).join(later, "id", "left_anti").select("text")


def learn_stems(rows: DataFrame, support: int = 5, precise: float = 0.9) -> dict[str, int]:
    """Stems of toxic texts of rows(text, toxic), and their classes.

    n toxic texts and no other have one by chance with probability p ** n, p being the share of toxic texts; n must be so
    large that less than a thousandth of a stem is expected so, and at least `support`. Of the texts that have one, a share
    of `precise` must be toxic. Both counts meet in a join; the driver gets the stems that pass.
    """
    toxic = stash(one_of_near_copies(rows.where("toxic = 1").select("text")), "toxic")
    n, every = toxic.count(), rows.count()
    if not 0 < n < every:
        return {}
    seen = stash(beginnings(toxic), "stems")
    chance = np.log(1000 * max(1, seen.count())) / -np.log(n / every)
    often = stash(seen.where(F.col("n") >= max(support, int(np.ceil(chance)))), "often")
    other = beginnings(rows.where("toxic = 0")).select("stem", F.col("n").alias("other"))
    good = other.join(maybe_broadcast(often, often.count(), 80), "stem", "right").where(F.col("n") >= precise * (F.col("n") + F.coalesce("other", F.lit(0))))
    counts = {r.stem: (r.n, r.meant) for r in good.select("stem", "n", "meant").collect()}  # the lexicon
    # Of nested stems the longest that nearly as many texts have; none that begins with another, or is a beginning of one.
    next_ones: dict[str, list[str]] = {}
    for s in sorted(counts):
        next_ones.setdefault(s[:-1], []).append(s)
    kept: set[str] = set()
    within: set[str] = set()
    for s in sorted(counts, key=lambda s: (len(s), s)):
        if s in within or any(s[:k] in kept for k in range(1, len(s) + 1)):
            continue
        while longer := [x for x in next_ones.get(s, []) if counts[x][0] >= 0.9 * counts[s][0]]:
            s = longer[0]
        kept.add(s)
        within |= {s[:k] for k in range(1, len(s) + 1)}
    return {s: VIOLENT if 2 * counts[s][1] > counts[s][0] else INSULT for s in sorted(kept)}


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float) -> None:
        self.lexicon, self.weights, self.bias, self.machine = lexicon, weights, bias, grammar()

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The score of a text, and start, end and weight of its matched clauses."""
        found = matched(text, self.lexicon, self.machine)
        z = self.bias + float(np.log1p(sum((uses for _, _, uses in found), np.zeros(len(ARCS)))) @ self.weights)
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z))))), [(a, b, float(uses @ self.weights)) for a, b, uses in found]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, pull: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic weights by damped Newton steps, pulled to the set ones, whose signs they keep."""
    prior = np.array([*ARCS.values(), BIAS])
    w, x = prior.copy(), np.hstack([x, np.ones((len(x), 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        w = w - 0.7 * np.linalg.solve(hessian, x.T @ (p - y) + pull * (w - prior))
        w[:-1] = np.where(prior[:-1] > 0, np.maximum(0, w[:-1]), np.minimum(0, w[:-1]))
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Stems from all labelled documents, weights from at most `sample` of them; none of those held out."""
    rows = stash(labelled(docs, labels), "labelled")
    lexicon = Lexicon(learn_stems(rows))
    machine = grammar()
    chosen = first_by_hash(rows, F.xxhash64("doc_id", "text", "toxic"), sample).select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py(), lexicon, machine).tolist() for t in batch.column("text")]
            yield pa.record_batch([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    got = chosen.mapInArrow(run, "toxic int, x array<double>").collect()  # `sample` rows of eight numbers
    y = np.array([r.toxic for r in got], dtype=float)
    if not 0 < y.sum() < len(y):
        return Model(lexicon, np.array(list(ARCS.values())), BIAS)
    return Model(lexicon, *fit(np.array([r.x for r in got]), y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, clauses) of every document: clauses has start, end and weight of each that matched, in the lower-cased text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # the lexicon and eight weights
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [held.value.score(t.as_py()) for t in batch.column("text")]
            clauses = [[{"start": a, "end": b, "weight": w} for a, b, w in c] for _, c in both]
            yield pa.record_batch([batch.column("doc_id"), pa.array([s for s, _ in both], pa.float64()), pa.array(clauses, kind)], names=["doc_id", "score", "clauses"])

    out = "doc_id long, score double, clauses array<struct<start: int, end: int, weight: double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by the contract of operator 3, and the number of matched clauses."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("clauses").alias("clauses"))
