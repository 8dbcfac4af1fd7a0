import random
import re

from tamiz.llm import licenses


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def check(docs):
    want = sorted((str(r.doc_id), *map(str, brute(r.text))) for r in docs.collect())
    rows = licenses.query(docs).collect()
    assert sorted((str(r.doc_id), str(r.n_words), str(r.n_base), str(r.first_word), str(r.last_word), r.base_labels) for r in rows) == want
    for r in rows:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    return {str(r.doc_id): r for r in rows}


def test_base_places(documents, odd, empty):
    check(documents)
    rows = check(odd)
    assert rows["11"].base_labels == "mit" and rows["11"].score == 1 and rows["1"].labels == ""
    assert licenses.query(empty).count() == 0


def test_places_are_all_counted(make):
    rows = check(make([(1, "MIT License, mit-license; the Apache  license\nand général public license. General Public License mit licenses"), (2, "permit license")]))
    assert rows["1"].n_base == 4 and rows["1"].base_labels == "apache,gpl,mit" and rows["2"].n_base == 0


def test_fuzzy_notices_are_found_with_spans(make):
    rnd = random.Random(3)
    for label, texts in licenses.NOTICES.items():
        for text in texts:
            s = list(text)
            for _ in range(len(text) // licenses.PER_ERROR):
                i = rnd.randrange(len(s))
                s[i] = rnd.choice("xq")
            scanner = licenses.Scanner()
            n, _, found = scanner.scan("some words before it. " + "".join(s).upper() + " and after")
            assert any(x[0] == label and abs(x[1] - 4) <= 2 for x in found), (label, "".join(s), found)


def test_clean_texts_have_no_notice(make):
    scanner = licenses.Scanner()
    assert scanner.scan("the quick brown fox jumps over the lazy dog " * 50)[2] == []
    assert scanner.scan(None) == (0, [], []) == scanner.scan("--- !!")


def test_exact_seed_for_every_bounded_error_match():
    """What the regex library finds anywhere in a text, the seeds find too."""
    import regex

    rnd = random.Random(9)
    notice = "licensed under the gnu general public license"
    scanner = licenses.Scanner({"x": [notice]})
    k = len(notice) // licenses.PER_ERROR
    for _ in range(200):
        s = list(notice)
        for _ in range(rnd.randint(0, k + 2)):
            op, i = rnd.randint(0, 2), rnd.randrange(len(s))
            s[i : i + (op > 0)] = [] if op == 1 else ["z"]
        text = "aa bb " + "".join(s) + " cc"
        assert bool(regex.search(f"(?:{notice}){{e<={k}}}", text)) == bool(scanner.fuzzy(text))


def test_every_copy_of_a_notice_is_found():
    """An edited copy before a better one, and many of them."""
    scanner = licenses.Scanner({"mit": ["released under the mit license"]})
    found = scanner.scan("released under the mit licence and then released under the mit license")[2]
    assert [(f, e) for _, f, _, e, _ in found] == [(0, 1), (7, 0)]
    found = scanner.scan("released under the mut license or " * 40)[2]
    assert [f for _, f, _, _, _ in found] == [6 * i for i in range(40)]
    words, base, _ = scanner.scan("x mit license y " * 30)
    assert words == 120 and [w for _, w in base] == [4 * i + 1 for i in range(30)]
