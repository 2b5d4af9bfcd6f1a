import random

import pytest
from pyspark.sql import functions as F

from rowtide.operators import epochs as ep

DDL = "snapshot_id long, table_id long, table string, op string, schema_json string, columns array<string>, changes map<string,array<string>>"


def commits(spark, rows):
    return spark.createDataFrame(
        [(s, t, n, op, shape, list(shape or ""), {"tables_created": [n]} if op == "create" else {}) for s, t, n, op, shape in rows], DDL)


HISTORY = [
    (1, 1, "a", "create", "x"), (2, 1, "a", "data", "x"), (3, 1, "a", "alter", "xy"), (4, 1, "b", "rename", "xy"),
    (5, 1, "b", "alter", "yx"), (6, 2, "c", "create", "k"), (7, 1, "b", "drop", "yx"), (8, 1, "b", "data", "q"),
    (9, 3, "b", "create", "x"), (10, None, None, "none", None),
]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_what_ends_an_epoch(spark):
    found = ep.epochs(commits(spark, HISTORY))
    assert rows(found, "table_id", "epoch", "start_snapshot", F.coalesce("end_snapshot", F.lit(-1)), F.coalesce("end_kind", F.lit("live"))) == [
        (1, 1, 1, 3, "schema_changed"), (1, 2, 3, 5, "schema_changed"), (1, 3, 5, 7, "table_dropped"),
        (2, 1, 6, -1, "live"), (3, 1, 9, -1, "live")]
    assert rows(found, "table_id", "epoch", "original_table", "table") == [
        (1, 1, "a", "a"), (1, 2, "a", "b"), (1, 3, "b", "b"), (2, 1, "c", "c"), (3, 1, "b", "b")]
    assert rows(ep.latest_epoch(found), "table_id", "epoch") == [(1, 3), (2, 1), (3, 1)]
    assert rows(ep.live_epochs(found), "table_id") == [(2,), (3,)]
    markers = ep.markers_of(found)
    assert rows(markers, "type", "table_id", "snapshot_id", F.concat_ws("", "columns")) == [
        ("schema_changed", 1, 3, "xy"), ("schema_changed", 1, 5, "yx"), ("table_dropped", 1, 7, "")]


def test_readers(spark):
    found = ep.consumers(ep.epochs(commits(spark, HISTORY)), "feed")
    assert rows(found, "consumer", "table_id", "status") == [
        ("feed", 1, "ended"), ("feed", 2, "active"), ("feed", 3, "active"), ("feed_3", 1, "ended"), ("feed_5", 1, "dropped")]
    assert rows(ep.dropped_names(found), "consumer", "dropped_name") == [("feed_5", "b")]
    renamed = found.withColumn("current_name", F.lit(None).cast("string"))
    assert rows(ep.dropped_names(renamed), "dropped_name") == [("b",)]
    assert rows(ep.lookup(found, "feed_3"), "table_id", "table") == [(1, "b")]
    assert len(rows(ep.existing_names(found), "consumer")) == 3
    assert rows(ep.create_if_absent(found, found.filter("table_id = 1")), "table_id") == [(2,), (3,)]
    assert ep.create_if_absent(found, found).isEmpty()


def test_recreation(spark):
    c = commits(spark, HISTORY)
    assert ep.created_snapshot(c, "b", 7).first()[0] == 9 and ep.created_snapshot(c, "b", 9).first()[0] is None
    drops = spark.createDataFrame([(1, "b", 7), (2, "c", 8)], "table_id long, table string, dropped_at long")
    assert {tuple(r) for r in ep.recreated(drops, c).collect()} == {(1, "b", 7, 9), (2, "c", 8, None)}


def test_every_change_meets_its_epoch(spark, never_broadcast):
    """A table with most of the changes, a snapshot with a third of them, and both sides of every
    boundary: compared with a plain search."""
    rng = random.Random(4)
    known = []
    for table in range(5):
        starts = sorted(rng.sample(range(1, 400), 40 if table == 0 else 2))
        ends = starts[1:] + [None if table % 2 else 450]
        known += [(table, i + 1, s, e) for i, (s, e) in enumerate(zip(starts, ends))]
    changes = [(t, rng.randrange(500), i) for i in range(2000) for t in [0 if i % 3 else rng.randrange(6)]]
    changes += [(0, 200, i) for i in range(2000, 3000)]
    frame = spark.createDataFrame(changes, "table_id long, snapshot_id long, rowid long")
    found = ep.assign_epoch(frame, spark.createDataFrame(known, "table_id long, epoch int, start_snapshot long, end_snapshot long"))
    got = {(r["table_id"], r["snapshot_id"], r["rowid"]): r["epoch"] for r in found.collect()}
    assert len(got) == len(changes)
    for t, s, i in changes:
        expected = [e for (kt, e, a, b) in known if kt == t and a <= s and (b is None or s < b)]
        assert got[(t, s, i)] == (expected[0] if expected else None)


def test_no_epochs(spark):
    frame = spark.createDataFrame([(1, 1, 1)], "table_id long, snapshot_id long, rowid long")
    none = spark.createDataFrame([], "table_id long, epoch int, start_snapshot long, end_snapshot long")
    assert ep.assign_epoch(frame, none).first()["epoch"] is None
