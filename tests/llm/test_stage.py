"""Intermediate tables: what they leave on the executors' disks."""

import pytest
from pyspark.sql import functions as F

from rowtide.llm import linedup, stage, suffixes
from .conftest import prose

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    """Names of the shuffle files that this session holds now."""
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (held.apply(i).getName() for i in range(held.size())) if name.startswith("shuffle_")}


def shuffled(spark):
    return spark.range(5000).selectExpr("id", "id % 100 AS k").groupBy("k").agg(F.min("id").alias("least"))


def test_staged_leaves_no_shuffle(spark):
    before = shuffle_files(spark)
    made = stage.staged(shuffled(spark), "made")
    assert not shuffle_files(spark) - before
    assert made.count() == 100
    assert spark.conf.get(CLEANUP) == "false"


def test_bucketed_is_grouped_without_a_shuffle_and_goes(spark):
    tables = {t.name for t in spark.catalog.listTables()}
    before = shuffle_files(spark)
    with stage.bucketed(shuffled(spark), "made", "k") as made:
        assert not shuffle_files(spark) - before
        plan = made.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert made.count() == 100
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_bucketed_goes_when_its_use_fails(spark):
    tables = {t.name for t in spark.catalog.listTables()}
    with pytest.raises(ValueError):
        with stage.bucketed(shuffled(spark), "made", "k"):
            raise ValueError
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_lines_leave_no_shuffle_and_no_table(spark, make):
    docs = make({i: prose(i % 9, 150) + f" {i}" for i in range(30)}, repeat=(), nameless=False)
    tables, before = {t.name for t in spark.catalog.listTables()}, shuffle_files(spark)
    linedup.repeated_lines(docs, linedup.BY_LENGTH)
    assert not shuffle_files(spark) - before
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_strings_are_hashed_once(spark, make, monkeypatch):
    """Of the strings that are compared one by one, texts and shuffles are done with when they are handed on."""
    docs = make({i: prose(i % 9, 150) + f" {i}" for i in range(30)}, repeat=(), nameless=False)
    docs = docs.select(F.col("doc_id").alias("doc"), "text", F.lit(0).cast("long").alias("t"))
    spans = docs.select("doc", "t", F.lit(0).alias("start"), F.lit(200).cast("short").alias("n"))
    before = shuffle_files(spark)
    found = suffixes.single_strings(docs, spans)
    assert not shuffle_files(spark) - before
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.groupBy("doc").count().where("count = 200").count() == 21
