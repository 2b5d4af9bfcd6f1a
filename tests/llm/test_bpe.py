import random

import pytest
from pyspark.sql import functions as F

from rowtide.llm import bpe
from rowtide.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return bpe._load(tokenizer_path())


def test_equals_the_library(docs, tokenizer):
    path = tokenizer_path()
    found = bpe.decode(bpe.encode(docs, path, keep=("doc_id", "text"), block_bytes=50_000, buckets=7), path).collect()
    assert len(found) == docs.count()
    for row in found:
        ids = tokenizer.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == ids
        assert row["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)


def test_random_characters(spark, tokenizer, tmp_path):
    r = random.Random(5)
    pool = [chr(c) for c in [*range(1, 0x250), 0x2028, 0x2029, 0x3000, 0x85, 0xA0, 0x1680, 0x300, 0x301, 0x3A3, 0x130, 0x1F600, 0xAC00, 0x1100, 0x1161]]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(120))) for _ in range(300)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    found = bpe.encode(spark.read.parquet(str(tmp_path / "t")), tokenizer_path()).collect()
    assert {r["doc_id"]: r["ids"] for r in found} == {
        i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_empty_table_and_derived_source(empty, docs):
    path = tokenizer_path()
    assert bpe.encode(empty, path).count() == 0
    some = docs.where("doc_id < 5").repartition(3, F.rand())
    assert bpe.encode(some, path, derived=True).count() == some.count()


def test_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [320, 10**6, -4])], "doc_id long, ids array<int>")
    found = {r["doc_id"]: r["decoded"] for r in bpe.decode(rows, tokenizer_path()).collect()}
    assert found[1] is None and found[2] == "" and " " not in found[3]


def test_refuses_tokenizers_that_keep_space():
    with pytest.raises(ValueError):
        bpe.check_tokenizer(tokenizer_path("byte_bpe_50k.json"))
