import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rowtide.llm import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(size_of):
    order = sorted(s for s in size_of if s is not None) + [None] * (None in size_of)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(size_of.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(2 * size_of[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size_of[s]]
        if not over:
            return share | {s: 2.0 * size_of[s] for s in full}
        full.update(over)


def test_targets_and_words_taken(docs, corpus):
    rows = mix.drawn(docs, block_words=500, shard_words=3000).collect()
    assert len(rows) == docs.count()
    size, taken, top = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        if r["doc_id"] is not None:
            assert r["size"] == len(WORD.findall(corpus[r["doc_id"]] or ""))
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * len(r["shards"])
        top[r["source"]] = max(top[r["source"]], r["size"])
        assert len(r["shards"]) <= 2
    wanted = targets(size)
    for r in rows:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
    assert all(abs(taken[s] - wanted[s]) <= top[s] for s in size)


def test_block_size_does_not_change_what_is_drawn(docs):
    one, two = (mix.drawn(docs, block_words=b, shard_words=4000).select("doc_id", "size", F.size("shards").alias("n")).collect()
                for b in (100, 10**9))
    assert Counter(map(tuple, one)) == Counter(map(tuple, two))


def test_reruns_agree(docs):
    one, two = (mix.drawn(docs, block_words=300, shard_words=2000).select("doc_id", "size", "shards").collect() for _ in range(2))
    assert Counter((r["doc_id"], r["size"], tuple(r["shards"])) for r in one) == Counter((r["doc_id"], r["size"], tuple(r["shards"])) for r in two)


def test_tree_deals_exact_quotas(spark):
    quotas = {"a": 500, "b": 77, "c": 3, "d": 0, "e": 1420}
    rows = mix.split_quotas(spark.createDataFrame(list(quotas.items()), "src string, n long"), 4).collect()
    per_source, per_shard = Counter(), Counter()
    for r in rows:
        per_source[r["src"]] += r["n"]
        per_shard[r["shard"]] += r["n"]
        assert r["n"] >= 0
    assert {s: per_source[s] for s in quotas} == quotas and len(per_shard) == 16
    assert max(per_shard.values()) - min(per_shard.values()) <= 4
    for src in quotas:
        at = 0
        for r in sorted((r for r in rows if r["src"] == src), key=lambda r: r["shard"]):
            assert r["first"] == at
            at += r["n"]


@pytest.mark.parametrize("t, k, n", [(20, 8, 10), (30, 30, 7), (30, 0, 7), (1, 1, 0), (9, 3, 9), (40, 39, 20), (400, 90, 200)])
def test_hypergeometric(spark, t, k, n):
    draw = mix.hypergeometric("t", "k", "n", "u")
    rows = spark.range(4000).selectExpr(f"{t}D AS t", f"{k}D AS k", f"{n}D AS n", "(id + 0.5D) / 4000 AS u")
    found = Counter(int(r["x"]) for r in rows.selectExpr(f"{draw} AS x").collect())
    ways = {x: math.comb(k, x) * math.comb(t - k, n - x) / math.comb(t, n) for x in range(max(0, n + k - t), min(n, k) + 1)}
    assert set(found) <= set(ways)
    assert all(abs(found[x] / 4000 - p) < 0.002 for x, p in ways.items())


def test_mixed_rows(docs):
    plan = Counter()
    for r in mix.drawn(docs, block_words=300, shard_words=2000).collect():
        plan[r["doc_id"]] += len(r["shards"])
    out = mix.mixed(docs, block_words=300, shard_words=2000)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +plan


def test_empty_and_wordless(empty, make):
    assert mix.drawn(empty).count() == 0 and mix.mixed(empty).count() == 0
    rows = mix.drawn(make({1: None, 2: "", 3: "  "}, repeat=(), nameless=False)).collect()
    assert [(r["size"], r["target"]) for r in rows] == [(0, 0.0)] * 3
