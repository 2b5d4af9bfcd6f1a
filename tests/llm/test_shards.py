import hashlib
from collections import defaultdict

from rowtide.llm import shards


def sizes(rows):
    held = defaultdict(int)
    for r in rows:
        held[r["shard"]] += r["n_bytes"]
    return held


def bits(doc_id):
    return format(int(hashlib.md5(("null" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16), "060b")


def test_every_shard_fits_and_splits_only_where_needed(make, corpus, monkeypatch):
    monkeypatch.setattr(shards, "_STEP", 3)  # several rounds of refinement
    texts = {i: t for i, t in corpus.items() if i not in (37, 38)} | {100 + i: "t" * (i % 50) for i in range(300)}
    rows = shards.assigned(make(texts), max_bytes=3000).collect()
    held = sizes(rows)
    assert len(rows) == len(texts) + 3 and max(held.values()) <= 3000
    whole = defaultdict(int)
    for r in rows:
        b = bits(r["doc_id"])
        assert r["shard"] == b[: r["depth"]] and r["shard_bytes"] == held[r["shard"]]
        for d in range(61):
            whole[b[:d]] += r["n_bytes"]
    for r in rows:
        assert r["depth"] == 0 or whole[r["shard"][:-1]] > 3000


def test_one_hash_too_large(spark):
    rows = [(7, "x" * 400)] * 30 + [(7, "y" * 900)] * 3 + [(1, "z"), (2, None)]
    found = shards.assigned(spark.createDataFrame(rows, "doc_id long, text string"), max_bytes=1000).collect()
    held = sizes(found)
    assert len(found) == 35 and max(held.values()) <= 1000 and len(held) >= 14


def test_one_document_over_the_limit(spark):
    found = shards.assigned(spark.createDataFrame([(1, "x" * 5000), (2, "y")], "doc_id long, text string"), max_bytes=1000).collect()
    assert len({r["shard"] for r in found}) == 2


def test_written_shards(make, corpus, tmp_path, spark):
    docs = make(corpus)
    shards.write_shards(docs, str(tmp_path / "s"), max_bytes=50_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and {"kept", "a.b"} <= set(back.columns)


def test_written_rows_of_one_id_are_not_multiplied(spark, tmp_path):
    rows = [(7, "x" * 400)] * 5 + [(7, "y" * 900)] * 2 + [(None, "z" * 600)] * 4 + [(1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shards.write_shards(docs, str(tmp_path / "s"), max_bytes=1000)
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted([(r["doc_id"], r["text"]) for r in back], key=key) == sorted(rows, key=key)
    held = {}
    for r in back:
        held[r["shard"]] = held.get(r["shard"], 0) + len(r["text"] or "")
    assert max(held.values()) <= 1000


def test_empty(empty):
    assert shards.assigned(empty).count() == 0
