import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtide.llm import suffixes
from .conftest import prose


def by_rule(texts, length):
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for at in range(len(b) - length + 1):
            s = b[at: at + length]
            if s in seen:
                cover[at] += 1
                cover[at + length] -= 1
            else:
                seen.add(s)
        gone = np.cumsum(cover)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out[i] = (len(b), int(gone.sum()), len(edges) // 2, np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


def result(docs, **settings):
    rows = suffixes.without_repeats(docs, **settings).where("doc_id IS NOT NULL").collect()
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows}


def test_equals_brute_force(docs, corpus):
    assert result(docs) == by_rule(corpus, 100)


@pytest.mark.parametrize("batches", [1, 3])
def test_other_lengths_and_small_alphabet(make, batches):
    r = random.Random(3)
    texts = {i: "".join(r.choice("ab") for _ in range(r.randrange(150))) for i in range(60)}
    texts |= {100 + i: prose(i % 5, 40)[r.randrange(40):][:180] for i in range(40)}
    assert result(make(texts), length=24, gram=7, batches=batches) == by_rule(texts, 24)


def test_long_text_in_segments(make, monkeypatch):
    texts = {1: prose(1, 9000), 2: prose(2, 50) + prose(1, 9000)[20_000:60_000], 3: prose(1, 9000)[100:41_000] * 2}
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 5000)
    assert result(make(texts)) == by_rule(texts, 100)


def test_long_text_repeats_itself_across_segments(make, monkeypatch):
    passage = prose(60, 80)
    texts = {1: prose(61, 100), 2: prose(62, 3000) + passage + prose(63, 4000) + passage + prose(64, 2000) + passage}
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 5000)
    expected = by_rule(texts, 100)
    assert expected[2][1] >= 2 * len(passage) and result(make(texts, repeat=(2,))) == expected


def test_family_of_levels(spark):
    index = suffixes.SuffixIndex(spark, buckets=2)
    sizes = []
    for i in range(5):
        batch = spark.createDataFrame([(i, prose(i, 60))], "doc long, text string")
        index.add(suffixes.suffix_array(batch))
        sizes.append([size for size, _ in index.levels])
    assert sizes == [[0], [1], [0, 1], [2], [0, 2]]
    spans = index.rows()
    assert spans.count() == spans.select("h", "s").distinct().count()
    index.drop()


def test_no_level_is_merged_with_the_last_batch(make, monkeypatch):
    """Four batches: the first two become one level; nothing is scanned against what the fourth would be merged into."""
    merges, merged = [], suffixes.SuffixIndex._merged
    monkeypatch.setattr(suffixes.SuffixIndex, "_merged", lambda self, *pair: merges.append(pair) or merged(self, *pair))
    texts = {i: prose(i % 9, 80)[i:] for i in range(12)}
    assert result(make(texts, repeat=()), batches=4) == by_rule(texts, 100)
    assert len(merges) == 1


def test_strings_of_a_slice_are_hashed_together(make, spark):
    """Strings keep their texts and places, with a text between them that is not asked for, and a row that is there twice."""
    passage = prose(65, 60)
    texts = {i: prose(60 + i, 20) + passage + prose(80 + i, 10 * i) for i in range(4)}
    docs = make(texts, repeat=(2,), nameless=False).coalesce(1).select(
        F.col("doc_id").alias("doc"), "text", F.lit(0).cast("long").alias("t"))
    at = {i: len(t[: t.index(passage)].encode()) for i, t in texts.items()}
    spans = spark.createDataFrame([(i, 0, at[i] + k, 10) for i in (0, 2, 3) for k in (0, 10)], "doc long, t long, start int, n short")
    found = {(r["doc"], r["start"]) for r in suffixes.single_strings(docs, spans).collect()}
    assert found == {(i, at[i] + k) for i in (2, 3) for k in range(20)}


@pytest.mark.parametrize("kinds", [1, 3, 10**6])
def test_in_order(kinds):
    r = np.random.default_rng(kinds)
    columns = [r.integers(0, kinds, 500) for _ in range(3)]
    assert (np.stack(columns)[:, suffixes.in_order(*columns)] == np.stack(columns)[:, np.lexsort(columns[::-1])]).all()
    assert len(suffixes.in_order(*(c[:0] for c in columns))) == 0


def test_copies_within_a_slice_do_not_meet_in_one_bucket(make):
    """Of equal texts one entry of each span is asked for; rows of one document are not each other's copies."""
    entries = suffixes.suffix_array(make({i: prose(70, 200) for i in range(30)}, repeat=(0,)).where(
        "doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "text").coalesce(1))
    rows = entries.collect()
    fresh = [r for r in rows if not r["again"]]
    assert {r["doc"] for r in fresh} == {0} and len({r["start"] for r in fresh}) * 2 == len(fresh)
    assert len(rows) == 31 * len(fresh) // 2 and len({r["h"] for r in rows}) > len(rows) // 2


def test_entries_are_shuffled_once(spark, capfd):
    """A batch is dealt by its spans once; its firsts and its repeats are made in these buckets."""
    index = suffixes.SuffixIndex(spark, buckets=2)
    plans, save = [], suffixes.SuffixIndex._save

    def seen(self, rows):
        rows.explain()
        plans.append(capfd.readouterr().out)
        return save(self, rows)

    suffixes.SuffixIndex._save, batch = seen, spark.createDataFrame([(1, prose(1, 60))], "doc long, text string")
    try:
        index.add(suffixes.suffix_array(batch))
    finally:
        suffixes.SuffixIndex._save = save
        index.drop()
    assert sum(p.count("Exchange hashpartitioning") for p in plans) == 1


def test_repeated_rows_null_id_empty(docs, empty):
    found = suffixes.without_repeats(docs)
    assert found.count() == docs.count()
    assert [r["n_removed"] for r in found.where("doc_id = 3").collect()] == [0, 0]
    assert found.where("doc_id IS NULL").count() == 1
    assert suffixes.without_repeats(empty).count() == 0


def test_texts_of_one_rank_are_told_apart(make):
    """Two texts without doc_id of unequal length, one with a repeat of its own and one with a copy of the other."""
    a, b, shared = prose(80, 30), prose(81, 400), prose(82, 60)
    long, short = b + a[:150] + b[:900] + shared, shared + a
    frame = make({1: prose(83, 40), 5: long + "1"}, repeat=(), nameless=False)
    other = frame.where("doc_id = 1")
    rows = [other, frame.where("doc_id = 5")]
    for doc_id, text in ((None, long), (None, short), (None, short), (7, prose(84, 90)), (7, prose(84, 90) + shared)):
        rows.append(other.withColumn("doc_id", F.lit(doc_id).cast("long")).withColumn("text", F.lit(text)))
    for docs in (rows[0].union(rows[2]).union(rows[3]).union(rows[4]), functools.reduce(lambda x, y: x.union(y), rows)):
        given = {((2**63 - 1) if r["doc_id"] is None else r["doc_id"], r["h"], r["text"])
                 for r in docs.withColumn("h", F.xxhash64("text")).collect()}
        ordered = sorted(given)
        expected = by_rule(dict(enumerate(text for _, _, text in ordered)), 100)
        wanted = {(i, expected[k]) for k, (i, _, _) in enumerate(ordered)}
        found = suffixes.without_repeats(docs).collect()
        assert len(found) == docs.count()
        assert {((2**63 - 1) if r["doc_id"] is None else r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])))
                for r in found} == wanted
