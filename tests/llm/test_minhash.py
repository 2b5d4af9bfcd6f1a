import random
import re

import pytest

from rowtide.llm import minhash
from rowtide.llm.components import components
from .conftest import edited, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i: i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def by_rule(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    order = sorted(texts)
    for k, i in enumerate(order):
        for j in order[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


def result(docs):
    rows = minhash.near_duplicates(docs).where("doc_id IS NOT NULL").collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}


def test_equals_brute_force(docs, corpus):
    assert result(docs) == by_rule(corpus)


def test_groups_chains_and_pivots_that_do_not_match(make):
    """Copies with edits of many sizes: links that do not go through the smallest document, and chains."""
    r, texts = random.Random(2), {}
    for g in range(8):
        text = prose(100 + g, 150)
        for k in range(14):
            texts[len(texts) + (50 - g) * 100] = edited(text, r.randrange(10**6), r.choice([0, 1, 2, 3, 4, 6]))
        for k in range(6):  # a chain: each a little further from the first
            text = edited(text, g * 10 + k, 1)
            texts[len(texts) + (50 - g) * 100] = text
    assert result(make(texts, repeat=(), nameless=False)) == by_rule(texts)


def test_keep_one(docs, corpus):
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, _, k) in by_rule(corpus).items() if k)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 101), (500, 200)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(found[i] == 1 for i in range(1, 61)) and found[103] == 100 and found[500] == 200


def test_nameless_and_empty(docs, empty):
    rows = minhash.near_duplicates(docs).where("doc_id IS NULL").collect()
    assert len(rows) == 1 and rows[0]["component_id"] is None and rows[0]["kept"]
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(empty).count() == 0
