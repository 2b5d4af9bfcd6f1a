import random

import pytest
from pyspark.sql import functions as F

from rowtide.operators import sequence
from rowtide.operators.dedup import first_copies, least_copies, not_in_log
from rowtide.operators.metrics import exact_percentiles
from rowtide.operators.sequence import assign_seq, look_along, number_groups, number_rows, running_count, union_log
from rowtide.schemas import EVENT


def test_total_order_without_gap(spark):
    rng = random.Random(1)
    values = [(rng.randrange(5), i) for i in range(5000)]
    rng.shuffle(values)
    df = spark.createDataFrame(values, "k int, i int").repartition(7)
    numbered, count = number_rows(df, ["k", "i"], base=100)
    assert count == 5000
    found = [(r["k"], r["i"]) for r in numbered.orderBy("seq").collect()]
    assert found == sorted(values)
    assert [r["seq"] for r in numbered.orderBy("seq").collect()] == list(range(101, 5101))


def test_hot_group_is_gap_free(spark):
    """One snapshot with most rows: nothing is lost."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).cast("long").alias("g"), F.col("id").alias("rowid"))
    numbered, count = number_groups(df.repartition(8), ["g"], ["rowid"])
    assert count == 20_000
    places = [(r["seq"], r["g"]) for r in numbered.orderBy("seq").collect()]
    assert [p for p, _ in places] == list(range(1, 20_001))
    assert [g for _, g in places] == sorted(g for _, g in places)


def test_groups_are_sorted_in_pieces_of_a_partition(spark):
    """A partition of any size is never sorted as a whole: rows are ordered within pieces, which follow one another."""
    df = spark.range(10).select(F.lit(None).cast("long").alias("g"), (9 - F.col("id")).alias("rowid")).coalesce(1)
    numbered, count = number_groups(df, ["g"], ["rowid"], base=5, piece_bits=2)
    found = [(r["seq"], r["rowid"]) for r in numbered.orderBy("seq").collect()]
    assert count == 10 and found == list(zip(range(6, 16), [6, 7, 8, 9, 2, 3, 4, 5, 0, 1]))
    mixed = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("rowid")).repartition(3)
    numbered, count = number_groups(mixed, ["g"], ["rowid"], piece_bits=4)
    places = [(r["seq"], r["g"]) for r in numbered.orderBy("seq").collect()]
    assert count == 1000 and [p for p, _ in places] == list(range(1, 1001))
    assert [g for _, g in places] == sorted(g for _, g in places)


def test_numbers_do_not_depend_on_the_number_of_groups(spark, folder):
    """One input staged once: many more groups beside it, and other joins, leave its numbers as they are."""
    few = spark.range(400).select((F.col("id") % 2).alias("g"), F.col("id").alias("rowid")).repartition(4)
    many = few.union(spark.range(5000).select((F.col("id") + 10).alias("g"), F.col("id").alias("rowid")))
    numbers = []
    for i, df in enumerate((few, many)):
        found, _ = number_groups(df, ["g"], ["rowid"], stage=f"{folder}/{i}")
        numbers.append({(r["g"], r["rowid"]): r["seq"] for r in found.filter("g < 2").collect()})
    assert numbers[0] == numbers[1] and len(numbers[0]) == 400


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g long, rowid long")
    assert number_groups(empty, ["g"], ["rowid"])[1] == 0
    assert number_rows(empty, ["g"])[1] == 0


def test_markers_stand_before_the_changes_of_their_snapshot(spark, log_of):
    changes = log_of([("insert", 1, "{}", 1), ("insert", 2, "{}", 2), ("update_postimage", 3, "{}", 2), ("update_preimage", 3, "{}", 2)]).drop("seq")
    markers = spark.createDataFrame([("schema_changed", 1, 2), ("table_dropped", 1, 2)], "type string, table_id long, snapshot_id long")
    for total in (True, False):
        numbered, _ = assign_seq(union_log(changes, markers), total_order=total)
        kinds = [(r["type"], r["change_type"]) for r in numbered.orderBy("seq").collect()]
        assert kinds[0] == ("change", "insert") and kinds[1][0] == "schema_changed" and kinds[-1][0] == "table_dropped"
        if total:  # otherwise the halves of an update may come in either order
            assert kinds.index(("change", "update_preimage")) < kinds.index(("change", "update_postimage"))


def test_empty_events(spark):
    events = spark.createDataFrame([], EVENT)
    numbered, count = assign_seq(union_log(events, events), 5)
    assert count == 0 and numbered.count() == 0


def test_look_along_and_running_count_in_small_cells(spark):
    rng = random.Random(5)
    rows = [(k, o, rng.choice([None, o])) for k in "ab" for o in rng.sample(range(300), 120)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    for ahead in (False, True):
        found = look_along(df, ["k"], "o", {"near": F.col("v")}, ahead=ahead, width=16).collect()
        assert len(found) == len(rows)
        for r in found:
            others = [v for k, o, v in rows if k == r["k"] and v is not None and (o > r["o"] if ahead else o < r["o"])]
            assert r["near"] == ((min if ahead else max)(others) if others else None)
    counted = running_count(df, ["k"], "o", F.col("v").isNotNull(), "n", width=16).collect()
    for r in counted:
        assert r["n"] == sum(1 for k, o, v in rows if k == r["k"] and o <= r["o"] and v is not None)


def test_first_copies_of_a_hot_id(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("message_id"), F.col("id").alias("seq"))
    kept = {r["message_id"]: r["seq"] for r in first_copies(df).collect()}
    assert len(kept) == 6001 and kept["hot"] == 0
    assert not_in_log(df, df.filter("message_id = 'hot'")).count() == 6000


def test_least_copies(spark):
    rows = [("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, "q"), ("b", 0, "p"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "message_id string, k int, `v.w` string").select("k", "message_id", "`v.w`")
    found = least_copies(df)
    assert found.columns == df.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "a", "y"), (None, "b", "q"), (1, None, "n")], key=str)


def test_percentiles(spark):
    rng = random.Random(2)
    values = [7.0] * 400 + [rng.random() * 20 for _ in range(777)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    found = {r["fraction"]: r["value"] for r in exact_percentiles(df, "x", [0.0, 0.3, 0.5, 0.99, 1.0]).collect()}
    ordered = sorted(values)
    for p, got in found.items():
        place = p * (len(ordered) - 1)
        low = int(place)
        high = min(low + 1, len(ordered) - 1)
        assert abs(got - (ordered[low] + (ordered[high] - ordered[low]) * (place - low))) < 1e-9
    assert exact_percentiles(df.filter("x < 0"), "x", [0.5]).first()["value"] is None
