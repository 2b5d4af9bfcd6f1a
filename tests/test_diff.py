import random

import pytest
from pyspark.sql import functions as F

from rowtide.operators.diff import diff_tables, duplicate_keys, inserts, snapshot_diff, with_rowid


def changes(old, new, key=("id",)):
    return sorted((r["rowid"], r["change_type"], tuple(r["row"])) for r in diff_tables(old, new, list(key)).collect())


def test_null_nan_and_zero(spark):
    nan = float("nan")
    old = spark.createDataFrame([(1, None), (2, None), (3, nan), (4, 0.0)], "id long, p double")
    new = spark.createDataFrame([(1, None), (2, 1.0), (3, nan), (4, -0.0)], "id long, p double")
    assert changes(old, new) == [(2, "update_postimage", (2, 1.0)), (2, "update_preimage", (2, None))]


def test_random_versions(spark):
    rng = random.Random(3)
    for _ in range(3):
        a = {i: rng.choice(["x", "y", None]) for i in range(200) if rng.random() < 0.7}
        b = {i: rng.choice(["x", "y", None]) for i in range(200) if rng.random() < 0.7}
        expected = []
        for i in a.keys() | b.keys():
            if i not in a:
                expected.append((i, "insert", (i, b[i])))
            elif i not in b:
                expected.append((i, "delete", (i, a[i])))
            elif a[i] != b[i]:
                expected += [(i, "update_preimage", (i, a[i])), (i, "update_postimage", (i, b[i]))]
        frame = lambda d: spark.createDataFrame(list(d.items()), "id long, v string")
        key = lambda c: (c[0], c[1], str(c[2]))
        found = [(r["rowid"], r["change_type"], tuple(r["row"])) for r in diff_tables(frame(a), frame(b), ["id"]).collect()]
        assert sorted(found, key=key) == sorted(expected, key=key)


def test_columns_missing_on_one_side(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, v string, gone int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", "z")], "id long, v string, added string")
    assert changes(old, new) == [(2, "update_postimage", (2, "b", "z")), (2, "update_preimage", (2, "b", None))]


@pytest.mark.parametrize("side", ["old", "new"])
def test_repeated_key_fails(spark, side):
    good = spark.createDataFrame([(1, "a")], "id long, v string")
    bad = spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    with pytest.raises(Exception, match="not unique"):
        changes(*((bad, good) if side == "old" else (good, bad)))


def test_null_key_fails(spark):
    bad = spark.createDataFrame([(None, "a")], "id long, v string")
    with pytest.raises(Exception, match="null or not unique"):
        changes(bad, bad)


def test_key_that_is_not_unique_is_found(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert not duplicate_keys(lines, ["l_orderkey", "l_linenumber"]).isEmpty()


def test_two_keys_with_one_hash_stay_apart(spark):
    """Rows that share a row id but not the key are two rows, not an update."""
    ddl = "rowid long, rowkey string, k string"
    old, new = (spark.createDataFrame([r], ddl).select("rowid", "rowkey", F.struct("k").alias("row"))
                for r in ((7, '{"k":"k1"}', "k1"), (7, '{"k":"k2"}', "k2")))
    found = sorted((r["rowkey"], r["change_type"]) for r in snapshot_diff(old, new).collect())
    assert found == [('{"k":"k1"}', "delete"), ('{"k":"k2"}', "insert")]


def test_text_and_composite_keys(spark):
    old = spark.createDataFrame([("a", 1, 1), ("a", 2, 1)], "k string, n int, v int")
    new = spark.createDataFrame([("a", 1, 2), ("b", 2, 1)], "k string, n int, v int")
    found = sorted((r["change_type"], tuple(r["row"])) for r in diff_tables(old, new, ["k", "n"]).collect())
    assert found == [("delete", ("a", 2, 1)), ("insert", ("b", 2, 1)),
                     ("update_postimage", ("a", 1, 2)), ("update_preimage", ("a", 1, 1))]


def test_own_column_names_are_no_trap(spark):
    ddl = "id long, snapshot_time string, table_name string, rowid string, change_type string"
    old = spark.createDataFrame([(1, "a", "b", "c", "d")], ddl)
    new = spark.createDataFrame([(1, "a", "b", "c", "e")], ddl)
    assert [c[1:] for c in changes(old, new)] == [
        ("update_postimage", (1, "a", "b", "c", "e")), ("update_preimage", (1, "a", "b", "c", "d"))]


def test_append_only_needs_no_shuffle(spark):
    plan = inserts(with_rowid(spark.range(10), ["id"]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_key_check_adds_no_shuffle(spark):
    """One exchange per side: the check uses the partitioning of the join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = with_rowid(spark.range(10).withColumn("v", F.lit(1)), ["id"])
        b = with_rowid(spark.range(10).withColumn("v", F.lit(2)), ["id"])
        plan = snapshot_diff(a, b)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in plan
    assert plan.count("Sort [") == 2
