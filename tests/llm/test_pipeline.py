"""The registered queries against their SQL, and the pipeline stage by stage against the operators' rules."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowtide.llm.oracle import ORACLE
from rowtide.llm.queries import QUERIES

from .test_minhash import by_rule as near_by_rule, shingles
from .test_mix import targets

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame, expected = QUERIES[name](spark, SF), con.sql(ORACLE[name])
    columns = sorted(frame.columns)
    assert columns == sorted(expected.columns)
    rows = [tuple(map(str, (r[expected.columns.index(c)] for c in columns))) for r in expected.fetchall()]
    assert sorted(tuple(str(r[c]) for c in columns) for r in frame.collect()) == sorted(rows)


def test_stages(spark, docs, corpus, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near dedup", "mixing", "encoding"]
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, before, SF).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "encoding":
            assert after.columns == docs.columns
        seen[name] = (before, after)
        before = after
    start, end = seen["near dedup"]
    texts = {r["doc_id"]: r["text"] for r in start.where("doc_id IS NOT NULL").collect()}
    assert {r["doc_id"] for r in end.where("doc_id IS NOT NULL").collect()} == {
        i for i, (_, _, kept) in near_by_rule(texts).items() if kept}
    start, end = seen["encoding"]
    assert end.count() == start.count() and end.where("n_tokens <> size(ids)").count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and rows.columns[:3] == ["doc_id", "source", "n_tokens"]


def test_near_dedup_from_80_percent(spark):
    """Pairs of documents of 104 words: two changed words leave 90 of 110 shingles, three 85 of 115."""
    rows, words = [], [f"w{i}" for i in range(4000)]
    for g in range(12):
        text = words[g * 104: g * 104 + 104]
        rows.append((g * 10, " ".join(text)))
        for k, changed in ((1, (20, 60)), (2, (20, 50, 80))):
            other = [f"x{g}.{k}.{i}" if i in changed else w for i, w in enumerate(text)]
            rows.append((g * 10 + k, " ".join(other)))
    a, b, c = (shingles(t) for _, t in rows[:3])
    assert 80 <= 100 * len(a & b) / len(a | b) < 85 and 100 * len(a & c) / len(a | c) < 80 and 100 * len(b & c) / len(b | c) < 80
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == {i for i, _ in rows if i % 10 != 1}
