import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from rowtide.llm import spelling
from .conftest import prose


def counts_by_rule(pairs):
    n = Counter()
    for id_, text in pairs:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'null' if id_ is None else id_}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def groups_by_rule(n):
    close = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(c, key=lambda v: (-n[v], v)) if c else None for w, c in close.items()}
    form = {w: b if b is not None and n[b] >= 10 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), k, len(close[w]), n[form[w]] if form[w] else None) for w, k in n.items()}


def result(words):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.group(words).collect()}


def test_counts_equal_brute_force(docs, make, spark):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["word"]: r["n"] for r in spelling.count_words(docs).collect()} == counts_by_rule(rows)
    texts = {i: f"{prose(i, 50).replace('.', 'é')} STRASSENBAHN straßenbahn Éclairage éclairage×÷ abcdefg1hijklmn x{'y' * (i % 9)}" for i in range(400)}
    found = {r["word"]: r["n"] for r in spelling.count_words(make(texts, nameless=False, repeat=())).collect()}
    assert found == counts_by_rule(texts.items()) and "strassenbahn" in found


def variants(seed, base, much):
    r, n = random.Random(seed), {}
    for word in base:
        n[word] = r.choice([2, 30, 500, 60_000])
        for _ in range(much):
            w = list(r.choice([word, *list(n)[-3:]]))
            at = r.randrange(len(w))
            w[at: at + 1] = r.choice([[], [r.choice("aeèst")], [w[at], r.choice("aeèst")]])
            if len(w) >= 7:
                n.setdefault("".join(w), r.choice([2, 3, 3, 20, 200, 5_000]))
    return n


def test_groups_equal_brute_force(spark):
    base = ["aaaaaaaa", "abababab", "mississippi", "éàéàéàéà", "listened", "silentde", "enlisted", "x" * 300, "kabellostarnerfu", "bananana", "ananabana"]
    n = variants(1, base, 60) | {"listenedx": 7, "listenedy": 7, "qwertyuio": 7, "qwertyuix": 70, "qwertyuxx": 700, "qwertyxxx": 7000, "qwertyxxz": 7000}
    frame = spark.createDataFrame(list(n.items()), "word string, n long").repartition(4)
    assert result(frame) == groups_by_rule(n)


def test_every_near_pair_shares_a_signature():
    r, place = random.Random(3), np.arange(1000)
    for _ in range(300):
        a = "".join(r.choice("abcdeé") for _ in range(r.randrange(7, 14)))
        at = r.randrange(len(a))
        for b in (a[:at] + "z" + a[at + 1:], a[:at] + r.choice("abz") + a[at:]):
            (own_a, own_b), (_, longer) = spelling.signatures(pa.array([a, b]), place)
            assert set(own_a) & set(own_b if len(a) == len(b) else longer)


def test_empty_and_ties(spark, empty):
    assert spelling.count_words(empty).count() == 0 and result(spelling.count_words(empty)) == set()
    tied = spark.createDataFrame([("abcdefgh", 2), ("abcdefgx", 20), ("abcdefga", 20)], "word string, n long")
    assert ("abcdefgh", "abcdefga", "abcdefga", 2, 2, 20) in result(tied)
