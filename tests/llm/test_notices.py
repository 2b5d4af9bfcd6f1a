import random
import re

import pytest

from rowtide.llm import notices
from .conftest import prose


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def fewest_edits(notice, text):
    """Least edits of the notice to any stretch of the text, by the whole table of distances."""
    before = list(range(len(notice) + 1))
    best = before[-1]
    for c in text:
        now = [0]
        for i, p in enumerate(notice, 1):
            now.append(min(before[i] + 1, now[i - 1] + 1, before[i - 1] + (p != c)))
        best, before = min(best, now[-1]), now
    return best


def by_rule(text):
    words = words_of(text)
    places = [(i, label) for phrase, label in notices.PHRASES for k in [phrase.split()]
              for i in range(len(words) - len(k) + 1) if words[i: i + len(k)] == k]
    padded = f" {' '.join(words)} "
    edits = [(fewest_edits(f" {wording} ", padded), wording, label) for wording, label in notices.NOTICES]
    held = [(e, wording, label) for e, wording, label in edits if e <= notices.budget(wording)]
    base = {label for _, label in places}
    score = 1.0 if places else max((1 - e / (len(wording) + 2) for e, wording, _ in held), default=0.0)
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {label for _, _, label in held})), round(score, 9))


def damaged(text, seed, edits):
    r, t = random.Random(seed), list(text)
    for _ in range(edits):
        at = r.randrange(len(t))
        t[at: at + 1] = r.choice([[], [r.choice("aeiot ")], [t[at], r.choice("aeiot")]])
    return "".join(t)


@pytest.fixture(scope="module")
def texts():
    found, r = {}, random.Random(4)
    for i, (wording, _) in enumerate(notices.NOTICES):
        for edits in (0, 1, 2, 3, 4, 5, 7):
            cased = "".join(c.upper() if r.random() < 0.2 else c for c in damaged(wording, 10 * i + edits, edits))
            found[100 * i + edits] = f"{prose(i, 12)} {cased.replace(' ', r.choice([' ', ', ', chr(10)]))}. {prose(i + 50, 9)}"
    found |= {
        2001: None, 2002: "", 2003: " .,\n", 2004: "MIT License", 2005: "mit license MIT LICENSE, the mit-license; emit license",
        2006: "Licensed under CC BY-NC 4.0.", 2007: "Licensed under CC BY 4.0.", 2008: "Released under the BSD license.",
        2009: "é mit license über Apache\x85License apache\tlicense", 2010: prose(3, 9000) + " general public  license " + prose(4, 50),
        2011: "released under the mit license " * 40, 2012: "reIeased undr the mit license released under teh mit licence",
        2013: "the apache license, version 2.0 (unlicensed under the apache license version 2 0)", 2014: "mit licens", 2015: "x" * 50_000,
    }
    return found


def test_equals_brute_force(make, texts):
    rows = notices.scan(make(texts, repeat=(2004,), nameless=False)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r["doc_id"] != 2010 and r["doc_id"] != 2015:
            assert (*r[1:7], round(r["score"], 9)) == by_rule(texts[r["doc_id"]]), texts[r["doc_id"]]
    long = next(r for r in rows if r["doc_id"] == 2010)
    assert long["first_word"] == 9000 and long["n_base"] == 1 and long["labels"] == "gpl"


def test_spans_hold_the_notice(make, texts):
    for r in notices.scan(make(texts, repeat=(), nameless=False)).collect():
        words = words_of(texts[r["doc_id"]])
        for s in r["spans"]:
            there = words[s["first_word"]: s["first_word"] + s["words"]]
            assert words_of(texts[r["doc_id"]][s["start"]: s["end"]]) == there
            allowed = [w for w, label in notices.NOTICES if label == s["label"]]
            assert any(fewest_edits(f" {w} ", f" {' '.join(there)} ") == s["edits"] <= notices.budget(w) for w in allowed)
    many = next(r for r in notices.scan(make({1: texts[2011]}, nameless=False)).collect())
    assert len(many["spans"]) == 40 and [s["first_word"] for s in many["spans"]] == list(range(0, 200, 5))


def test_awkward_and_empty(docs, empty, corpus):
    rows = {r["doc_id"]: r for r in notices.scan(docs).collect()}
    assert set(rows) == set(corpus) | {None}
    for i in (20, 21, 22):
        assert tuple(rows[i])[1:] == (0, 0, None, None, "", "", 0.0, [])
    assert all(rows[i]["n_words"] == len(words_of(t)) for i, t in corpus.items())
    assert notices.scan(empty).count() == 0
    assert notices.scan(docs, notices=(), phrases=()).where("labels <> '' OR score <> 0").count() == 0
