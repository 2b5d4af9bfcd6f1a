import re

import numpy as np
import pytest

from rowtide.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i: i + 8]) for i in range(len(words) - 7)]
    count, covered = {}, set()
    for w in windows:
        count[w] = count.get(w, 0) + 1
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_counts_equal_brute_force(docs, corpus):
    rows = quality.judge(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] is None:
            continue
        n, chars, symbols, dup, repeat = base(corpus[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert not (r["base_failed"] and r["kept"])


def test_keep_good_agrees_with_judge(docs):
    good = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == good
    assert 0 in good and 5 in good and not {20, 21, 22, 23, 32, 33} & good


def test_fit_finds_the_precise_rules():
    r = np.random.default_rng(4)
    good = r.random(20_000) < 0.85
    rate = np.where(good[:, None], 0.003, 0.5)
    votes = np.where(r.random((20_000, 5)) < 0.2, -1, np.where(r.random((20_000, 5)) < rate, 0, 1))
    patterns, which, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    judged = quality.fit(patterns, count.astype(float))[which.ravel()] >= 0.5
    assert (judged == good).mean() > 0.97


def test_votes_outweigh_the_prior():
    """Rules whose rates are far from the prior: the same votes, of more documents, are judged better, and a rule that
    blames at random, as often in either class, ends up without a say."""
    r = np.random.default_rng(5)
    rates = np.array([[0.8, 0.7, 0.9, 0.6, 0.3], [0.05, 0.1, 0.02, 0.08, 0.3]])  # bad, good; the last at random
    good = r.random(50_000) < 0.7
    votes = np.where(r.random((50_000, 5)) < rates[good.astype(int)], 0, 1)
    patterns, which, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    exact = np.array([np.prod(np.where(p == 0, rates, 1 - rates), axis=1) * [0.3, 0.7] for p in patterns])
    exact = exact[:, 1] / exact.sum(axis=1)
    few, many = (np.abs(quality.fit(patterns, count * k) - exact) @ count / count.sum() for k in (0.01, 20.0))
    assert many < 0.01 < few
    judged = {tuple(p): g for p, g in zip(patterns, quality.fit(patterns, count * 20.0))}
    assert all(abs(judged[(*p[:4], 0)] - judged[(*p[:4], 1)]) < 0.1 for p in patterns if (*p[:4], 0) in judged and (*p[:4], 1) in judged)


def test_labels(spark):
    """Held against labels the rules never see: junk goes, good documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    counts = quality.judge(docs).where("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    found = {(r["quality"], r["kept"]): r["count"] for r in counts}
    assert found.get((1, True), 0) / max(1, found.get((1, True), 0) + found.get((1, False), 0)) > 0.98
    assert found.get((0, False), 0) / max(1, found.get((0, True), 0) + found.get((0, False), 0)) > 0.9


def test_empty(empty):
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0
