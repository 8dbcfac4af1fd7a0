import random
from itertools import product

import numpy as np

from tamiz.llm import toxicity as t

NAMES = list(t.ARCS)


def uses(text, learned=None):
    """Uses of each arc weight over a text, and the number of matched clauses."""
    found = t.matched(text, t.Lexicon(learned), t.grammar())
    total = sum((u for _, _, u in found), np.zeros(len(NAMES)))
    return {n: int(c) for n, c in zip(NAMES, total, strict=True) if c}, len(found)


def test_grammar():
    assert uses("you are an idiot") == ({"insult": 1, "aimed insult": 1}, 1) == uses("an idiot, you")
    assert uses("you are not an idiot") == ({"insult": 1, "denied": 1}, 1)
    assert uses("he is not never an idiot") == ({"insult": 1, "aimed insult": 1}, 1)
    assert uses("someone said idiot") == ({"insult": 1, "reported": 1}, 1)
    assert uses("such idiots here. Not there. I will kill you!") == ({"insult": 1, "stressed insult": 1, "threat": 1, "intended threat": 1, "aimed threat": 1}, 2)
    assert uses("IDIOT! idiot! moron") == ({"insult": 3}, 3)
    assert uses("nothing to see, you said") == ({}, 0) == uses(None) == uses("")
    assert uses("a vequmo here", {"vequ": t.INSULT}) == ({"insult": 1}, 1)
    assert uses("we will vequmo you", {"vequ": t.VIOLENT})[0] == {"threat": 1, "intended threat": 1, "aimed threat": 1}
    assert uses("an oaf", {"oaf$": t.INSULT}) == ({"insult": 1}, 1) and uses("oafish", {"oaf$": t.INSULT}) == ({}, 0)
    assert [x[:2] for x in t.matched("Fine. You idiot! Fine", t.Lexicon(), t.grammar())] == [(5, 15)]


def by_hand(classes):
    """Uses of the arc weights over one clause, by the rules as the module's docstring has them."""
    out, waits, aimed = dict.fromkeys(NAMES, 0), None, False
    for i, c in enumerate(classes):
        before = classes[:i]
        if c == t.TARGET:
            if waits and not aimed:
                out[waits] += 1
            waits, aimed = None, True
        if c not in (t.INSULT, t.VIOLENT):
            continue
        name = "insult" if c == t.INSULT else "threat"
        out[name] += 1
        if c == t.INSULT and before[-1:] == [t.STRESSED]:
            out["stressed insult"] += 1
        if c == t.VIOLENT and t.INTENDED in before:
            out["intended threat"] += 1
        last = max((j for j, x in enumerate(before) if x in (t.INSULT, t.VIOLENT)), default=-1)
        denied, told = before[last + 1 :].count(t.NEGATION) % 2 == 1, t.REPORT in before
        if told:
            out["reported"] += 1
        elif denied:
            out["denied"] += 1
        elif aimed:
            out[f"aimed {name}"] += 1
        else:
            waits = f"aimed {name}"
    return {n: c for n, c in out.items() if c}


def test_composed_machine_against_the_rules():
    machine, rnd = t.grammar(), random.Random(1)
    some = [list(x) for x in product([t.INSULT, t.TARGET, t.NEGATION, t.REPORT, t.VIOLENT], repeat=4)]
    some += [[rnd.randrange(8) for _ in range(rnd.randint(1, 12))] for _ in range(3000)]
    for classes in some:
        state, got = 0, dict.fromkeys(NAMES, 0)
        for c in classes:
            state, _, names = machine.table[state, (c, 0)]
            for n in names:
                got[n] += 1
        assert {n: c for n, c in got.items() if c} == by_hand(classes), classes


def test_composition_is_one_after_the_other():
    machine = t.grammar()
    parts = [t.insulting(), t.threatening(), t.reporting(), t.negating(), t.targeting()]
    rnd = random.Random(2)
    for _ in range(500):
        states, state = [0] * 5, 0
        for c in [rnd.randrange(8) for _ in range(8)]:
            symbol, names = (c, 0), ()
            for k, m in enumerate(parts):
                states[k], symbol, more = m.table[states[k], symbol]
                names += more
            state, out, got = machine.table[state, (c, 0)]
            assert out == symbol and got == names


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{x}.parquet") for x in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    every = t.query(docs, labels).collect()
    assert len(every) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in every)
    rows = [r for r in every if r.held_out and r.doc_id in known]
    assert len(rows) > 50 and sum(r.predicted == known[r.doc_id] for r in rows) >= 0.9 * len(rows)
    assert not any(r.predicted for r in rows if known[r.doc_id] == 0)


def test_query_scores_by_the_model(spark, documents):
    """Every document's score is that of the trained model, by the rules alone."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = t.train(documents, labels)
    got = {r.doc_id: r.score for r in t.query(documents, labels).collect()}
    for r in documents.collect():
        total = dict.fromkeys(NAMES, 0)
        for clause in t.CLAUSES.split((r.text or "").lower()):
            classes = [model.lexicon.of(w) for w in t.WORDS.findall(clause)]
            for n, c in by_hand(classes).items():
                total[n] += c
        z = model.bias + sum(np.log1p(total[n]) * w for n, w in zip(NAMES, model.weights, strict=True))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def test_near_copies_teach_no_stems(spark):
    base = "jubar kelim sonat verid pludo marek tolin gasep " * 3
    toxic = [(f"{base} copy{i} idiot", 1) for i in range(60)]
    clean = [(f"clean{i} words{i} here{i} stand{i} alone", 0) for i in range(300)]
    other = [(f"unlike{i} things{i} zorbak{i} written{i} there{i} you zit", 1) for i in range(40)]
    threats = [(f"unlike{i} we will vashnak{i} you and others{i}", 1) for i in range(40)]
    rows = spark.createDataFrame(toxic + clean + other + threats, "text string, toxic int")
    stems = t.learn_stems(rows)
    of = lambda w: [c for s, c in stems.items() if w.startswith(s) or s.startswith(w)]
    assert of("zorbak") == [t.INSULT] == of("zit$") and of("vashnak") == [t.VIOLENT]
    assert not any(s.startswith(("jub", "kel", "son", "ver", "plu")) for s in stems)


def test_odd_and_empty(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    rows = t.query(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert t.query(odd, labels.limit(0)).count() == odd.count()
    assert t.query(empty, labels).count() == 0
