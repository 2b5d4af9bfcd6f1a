import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F, types as T

from rowtide.operators.pairs import feed
from rowtide.operators.positions import LogWasReset, PositionTooOld, check_position, position_status
from rowtide.sources import files
from rowtide.sources.lake import Lake
from rowtide.sources.log import EventLog
from rowtide.sources.manifests import in_steps
from rowtide.sources.viewstore import ViewStore
from rowtide.streaming import dedup as sd
from rowtide.streaming.capture import Capture
from rowtide.streaming.follow import Follower
from rowtide.streaming.subscribe import Subscription, activity_feed


class World:
    """A lake with one table, its log, and short cuts."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.lake, self.log = Lake(spark, f"{folder}/lake"), EventLog(spark, f"{folder}/log").create(0)
        self.capture = Capture(self.lake, self.log)
        self.table = self.lake.create("orders", self.rows([(1, "a"), (2, "b")]), ["id"])

    def rows(self, rows, ddl="id long, v string"):
        return self.spark.createDataFrame(rows, ddl)

    def publish(self):
        done = self.log.newest()["end_snapshot"]
        return self.capture.publish_commits(self.lake.commits().filter(F.col("snapshot_id") > done).collect())

    def follower(self, name="view", buckets=4):
        return Follower(self.log, self.table, ViewStore(self.spark, f"{self.folder}/{name}", buckets))


@pytest.fixture
def world(spark, folder):
    return World(spark, folder)


def view_of(follower):
    return {r["rowid"]: dict(r["row"]) for r in follower.rows().collect()}


def test_missing_state_then_saved(world):
    store = ViewStore(world.spark, f"{world.folder}/deep/er/state")
    assert store.load() is None and store.rows().count() == 0
    rows = world.spark.createDataFrame([(1, 1, {"id": "1"}, 7)], "table_id long, rowid long, row map<string,string>, seq long")
    store.save({"last_seq": 7}, rows)
    assert store.load()["last_seq"] == 7 and store.rows().first()["row"] == {"id": "1"}


def test_follow_resume_and_restart(world):
    reader = world.follower()
    reader.open(0)
    world.publish()
    reader.run_available(f"{world.folder}/cp")
    assert view_of(reader) == {1: {"id": "1", "v": "a"}, 2: {"id": "2", "v": "b"}}
    # a thousand rows and a change of shape while nobody reads
    world.lake.append(world.table, world.spark.range(100, 1100).select("id", F.lit("n").alias("v")))
    world.publish()
    world.lake.alter(world.table, T.StructType([*world.lake.state(world.table).schema.fields, T.StructField("w", T.IntegerType())]))
    world.publish()
    state = world.follower().run_available(f"{world.folder}/cp")
    assert state["columns"] == ["id", "v", "w"] and state["received"] == 1003 and not state["needs_reload"]
    found = view_of(reader)
    assert len(found) == 1002 and found[1] == {"id": "1", "v": "a", "w": None} and found[500]["v"] == "n"
    # again from the start, without checkpoint and state: the same view
    other = world.follower("other")
    other.run_available(f"{world.folder}/cp2", start_after=0)
    assert view_of(other) == found
    status = other.status().first()
    assert (status["status"], status["waiting"], status["rows"], status["channel"]) == ("offline", 0, 1002, "changes.1")


def test_applying_a_batch_twice(world):
    world.publish()
    reader = world.follower()
    reader.open(0)
    batches = world.log.batches().collect()
    once = reader.apply(batches)
    assert reader.apply(batches) == once


def parquet_files(store):
    return {str(p) for p in Path(store.path).rglob("*.parquet")}


def test_a_changed_row_is_one_small_file_and_a_marker_none(world):
    world.lake.append(world.table, world.spark.range(100, 200).select("id", F.lit("n").alias("v")))
    world.publish()
    reader = world.follower(buckets=8)
    reader.open(0)
    before = reader.apply(world.log.batches().collect())
    assert len(before["folders"]) == 8 and before["deltas"] == []
    there = parquet_files(reader.store)
    world.lake.append(world.table, world.rows([(1000, "z")]))
    world.publish()
    after = reader.apply(world.log.batches().collect())
    assert after["folders"] == before["folders"] and len(after["deltas"]) == 1
    added = parquet_files(reader.store) - there
    assert len(added) == 1 and Path(added.pop()).stat().st_size < 10_000
    there = parquet_files(reader.store)
    world.lake.alter(world.table, T.StructType([*world.lake.state(world.table).schema.fields, T.StructField("w", T.IntegerType())]))
    world.publish()
    marked = reader.apply(world.log.batches().collect())
    assert parquet_files(reader.store) == there and marked["columns"] == ["id", "v", "w"]
    assert marked["touched"] == [{"name": "w", "removed_at": None, "touched_at": 104, "is_added": True}]
    found = view_of(reader)
    assert len(found) == 103 and found[1000] == {"id": "1000", "v": "z", "w": None} and found[1]["w"] is None


CHANGED = "table_id long, rowid long, rowkey string, change_type string, row map<string,string>, seq long"


def test_view_store_equals_a_dict_through_compactions(spark, folder):
    """Many small deltas with updates, deletes and columns that come, go and come back, merged by size, then into
    the base; after every step the rows equal those of a plain dictionary."""
    r = random.Random(5)
    store = ViewStore(spark, f"{folder}/view", buckets=3, compact_from=7_000, fan=3)
    state, rows, touched, seq, seen, kept = store.save({"table_id": 1}), {}, {}, 0, [], {}
    for step in range(20):
        batch = {}
        if step % 5 == 4:  # a marker alone
            seq += 1
            name, adds = f"c{r.randrange(3)}", r.random() < 0.5
            touched[name] = {"name": name, "removed_at": touched.get(name, {}).get("removed_at") if adds else seq,
                             "touched_at": seq, "is_added": adds}
            for row, _ in rows.values():
                row.setdefault(name, None) if adds else row.pop(name, None)
        else:
            for key in r.sample(range(40), r.randrange(1, 12)):
                seq += 1
                row = {"id": str(key), "v": str(seq), **{n: str(seq) for n, t in touched.items() if t["is_added"]}}
                gone = r.random() < 0.3
                batch[key] = (1, key, "", "delete" if gone else "insert", row, seq)
                rows.pop(key, None) if gone else rows.__setitem__(key, (row, seq))
        changes = spark.createDataFrame(list(batch.values()), CHANGED).coalesce(1) if batch else None
        state = store.take({**state, "last_seq": seq}, changes, sorted(touched.values(), key=lambda t: t["name"]))
        seen.append((len(state["deltas"]), len(state["folders"])))
        if step % 4 == 3:
            found = {x["rowid"]: (dict(x["row"]), x["seq"]) for x in store.rows(state).collect()}
            assert found == rows
        kept[step] = (state, {k: (dict(row), s) for k, (row, s) in rows.items()})
    assert max(n for n, _ in seen) >= 2 and max(n for _, n in seen) == 3 and len({s["folders"]["0"] for s, _ in kept.values() if s["folders"]}) > 1
    old, expected = kept[10]  # a version stays readable while newer ones are written
    assert {x["rowid"]: (dict(x["row"]), x["seq"]) for x in store.rows(old).collect()} == expected


def test_two_readers_on_one_store(world):
    world.publish()
    first, second = world.follower(), world.follower()
    state = first.open(0)
    first.store.save(state)
    with pytest.raises(files.AlreadyThere):
        second.store.save(state)


def test_crash_between_rows_and_version(world, monkeypatch):
    world.publish()
    reader = world.follower()
    reader.open(0)
    from rowtide.sources import files

    write = files.write_json
    monkeypatch.setattr(files, "write_json", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        reader.apply(world.log.batches().collect())
    monkeypatch.setattr(files, "write_json", write)
    assert reader.store.load()["last_seq"] == 0 and view_of(reader) == {}
    reader.apply(world.log.batches().collect())
    assert len(view_of(reader)) == 2


def test_new_reader_starts_at_the_end_and_start_over(world):
    world.publish()
    reader = world.follower()
    assert reader.open()["last_seq"] == 2
    world.lake.append(world.table, world.rows([(3, "c")]))
    world.publish()
    reader.run_available(f"{world.folder}/cp")
    assert view_of(reader) == {3: {"id": "3", "v": "c"}}
    state = reader.start_over()
    assert view_of(reader) == {} and state["last_seq"] == 3 and state["columns"] == []


def test_reload_then_go_on(world):
    world.publish()
    world.lake.replace(world.table, world.rows([(1, "x"), (3, "c")]))
    world.lake.append(world.table, world.rows([(4, "d")]))
    world.publish()  # one batch covers both snapshots
    world.lake.append(world.table, world.rows([(5, "e")]))
    world.publish()
    reader = world.follower()
    state = reader.reload(world.lake, 2)
    assert sorted(view_of(reader)) == [1, 3] and state["last_seq"] == 6
    reader.run_available(f"{world.folder}/cp")
    assert sorted(view_of(reader)) == [1, 3, 4, 5] and view_of(reader)[1]["v"] == "x"
    newest = world.follower("newest")
    assert newest.reload(world.lake)["last_seq"] == 8 and len(view_of(newest)) == 4


def test_too_old_and_reset(world):
    world.publish()
    reader = world.follower()
    reader.open(0)
    world.lake.append(world.table, world.rows([(3, "c")]))
    world.publish()
    world.log.retain(max_batches=1)
    with pytest.raises(PositionTooOld):
        reader.open()
    assert reader.reconnect(f"{world.folder}/cp") is None
    assert reader.status().first()["status"] == "error"
    reader.start_over()
    assert reader.status().first()["status"] == "offline"
    with pytest.raises(PositionTooOld):
        Subscription(world.log, world.table, f"{world.folder}/sub", start_after=0)
    with pytest.raises(LogWasReset):
        Subscription(world.log, world.table, f"{world.folder}/sub2", start_after=99)
    lost = EventLog(world.spark, f"{world.folder}/new").create(0)
    with pytest.raises(LogWasReset):
        Follower(lost, world.table, reader.store).open()


@pytest.mark.parametrize("last,first,head,error", [
    (4, 5, 9, None), (3, 5, 9, PositionTooOld), (0, 0, 0, None), (10, 5, 9, LogWasReset), (9, 5, 9, None)])
def test_positions(last, first, head, error):
    if error:
        with pytest.raises(error):
            check_position(last, first, head)
    else:
        check_position(last, first, head)


def test_position_status(spark):
    readers = spark.createDataFrame([(None,), (4,), (3,), (10,)], "last_seq long")
    found = [r["position_status"] for r in position_status(readers, 5, 9).collect()]
    assert found == ["start_at_end", "resume", "too_old", "log_was_reset"]


def handled(sub):
    calls = []
    sub.on_change(lambda c: calls.append(sorted(
        (r["type"], r["rowid"], r["row"] and r["row"]["v"], r["before"] and r["before"]["v"]) for r in c.collect())))
    sub.on_schema_change(lambda columns: calls.append(columns))
    sub.on_table_dropped(lambda: calls.append("dropped"))
    return calls


def test_subscription_in_order_to_the_drop(world):
    world.lake.replace(world.table, world.rows([(1, "x"), (3, "c")]))
    world.lake.alter(world.table, T.StructType([*world.lake.state(world.table).schema.fields, T.StructField("w", T.IntegerType())]))
    world.lake.append(world.table, world.rows([(4, "d", 1)], "id long, v string, w int"))
    world.lake.drop(world.table)
    world.lake.create("orders", world.rows([(7, "q")]), ["id"])
    world.publish()
    sub = Subscription(world.log, world.table, f"{world.folder}/sub", start_after=0)
    calls = handled(sub)
    sub.run_available(f"{world.folder}/cp")
    assert calls == [
        [("delete", 2, None, "b"), ("insert", 1, "a", None), ("insert", 2, "b", None), ("insert", 3, "c", None), ("update", 1, "x", "a")],
        ["id", "v", "w"], [("insert", 4, "d", None)], "dropped"]
    assert sub.ended
    sub.deliver(world.log.batches().collect())
    assert len(calls) == 4


def test_start_between_the_halves_of_an_update(world):
    world.publish()
    world.lake.replace(world.table, world.rows([(1, "x"), (2, "y")]))
    world.publish()
    kinds = [(r["seq"], r["change_type"]) for r in world.log.read(after=2).orderBy("seq").collect()]
    assert [k for _, k in kinds] == ["update_preimage", "update_postimage"] * 2
    sub = Subscription(world.log, world.table, f"{world.folder}/sub", start_after=3)
    calls = handled(sub)
    sub.deliver(world.log.batches().collect())
    assert calls == [[("update", 1, "x", "a"), ("update", 2, "y", "b")]] and sub.position == 6
    resumed = Subscription(world.log, world.table, f"{world.folder}/sub")
    more = handled(resumed)
    resumed.deliver(world.log.batches().collect())
    assert more == []


def test_failing_handler_repeats_the_batch(world):
    world.publish()
    sub = Subscription(world.log, world.table, f"{world.folder}/sub", start_after=0)
    sub.on_change(lambda c: (_ for _ in ()).throw(RuntimeError("no")))
    with pytest.raises(RuntimeError):
        sub.deliver(world.log.batches().collect())
    assert sub.position == 0
    calls = handled(sub)
    sub.deliver(world.log.batches().collect())
    assert len(calls) == 1 and sub.position == 2


def test_feed(world):
    world.publish()
    for n in range(3):
        world.lake.replace(world.table, world.rows([(1, f"x{n}"), (2, "b")]))
        world.publish()
    entries = activity_feed(world.log, world.table, length=2).collect()
    assert [(e["seq"], e["kind"], e["rowid"]) for e in entries] == [(7, "update", 1), (5, "update", 1)]
    assert entries[0]["before"] == '{"id":1,"v":"x1"}' and entries[0]["after"] == '{"id":1,"v":"x2"}'
    assert len(activity_feed(world.log, world.table).collect()) == 5


def test_feed_from_kept_entries(world, monkeypatch):
    """From every position as the log itself says, also where it cuts a batch or an update; and once a batch was asked
    about, its events are not opened again."""
    world.publish()
    for n in range(4):
        world.lake.replace(world.table, world.rows([(k, f"x{n if k % 2 else 0}") for k in range(1 + n, 6 + n)]))
        world.publish()
    opened, real = [], world.log.in_batches

    def watched(tokens, table_id, after=None):
        opened.append(len(tokens))
        return real(tokens, table_id, after)

    monkeypatch.setattr(world.log, "in_batches", watched)
    for length in (2, 5):
        for after in range(0, world.log.head() + 1, 3):
            expected = feed(world.log.read(world.table, after=after), length).collect()
            assert activity_feed(world.log, world.table, after, length).collect() == expected
        assert sum(opened) > 0
        opened.clear()
        assert len(activity_feed(world.log, world.table, length=length).collect()) == length and sum(opened) == 0


def test_stream_keeps_running_and_disconnects(world):
    reader = world.follower()
    query = reader.start(f"{world.folder}/cp", start_after=0, interval="0 seconds")
    try:
        world.publish()
        query.processAllAvailable()
        assert reader.status().first()["status"] == "online" and len(view_of(reader)) == 2
    finally:
        reader.disconnect()
    assert reader.status().first()["status"] == "offline"


def test_pairs_over_batches(spark, folder):
    """Halves that come in different micro-batches, in either order, with a restart between."""
    ddl = "seq long, table_id long, snapshot_id long, rowid long, type string, change_type string, row string"
    half = lambda seq, rowid, kind: (seq, 1, 1, rowid, "change", f"update_{kind}", f"{kind}{rowid}")
    batches = [
        [half(1, 1, "preimage"), half(2, 2, "postimage")], [half(3, 1, "postimage")],
        [half(4, 3, "preimage"), half(5, 2, "preimage"), half(6, 4, "preimage"), half(7, 4, "postimage")]]
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(f"{folder}/in")
        stream = spark.readStream.schema(ddl).json(f"{folder}/in")
        sd.pair_stream(stream, f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    found = sorted((r["rowid"], r["before"], r["after"], r["first_seq"], r["last_seq"]) for r in sd.read_pairs(spark, f"{folder}/out").collect())
    assert found == [(1, "preimage1", "postimage1", 1, 3), (2, "preimage2", "postimage2", 2, 5), (4, "preimage4", "postimage4", 6, 7)]
    assert [r["rowid"] for r in sd.lone_halves(spark, f"{folder}/out").collect()] == [3]


def test_pairs_cost_what_their_batch_holds(spark, folder):
    """Twelve batches of a day each: every update is given once, state is kept for the days that may still get halves,
    and a batch touches the state of its own updates only."""
    ddl = "seq long, table_id long, snapshot_id long, snapshot_time timestamp, rowid long, type string, change_type string, row string"
    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    half = lambda n, rowid, kind: (10_000 * n + rowid, 1, n, day(n), rowid, "change", f"update_{kind}", f"{kind}{n}-{rowid}")
    progress = []
    for n in range(12):
        rows = [half(n, i, "preimage") for i in range(20)] + [half(n, i, "postimage") for i in range(15)]
        rows += [half(n - 1, i, "postimage") for i in range(15, 19)] if n else []  # a day late
        rows += [half(n - 1, i, "postimage") for i in range(3)] if n else []  # copies
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(f"{folder}/in")
        query = sd.pair_stream(spark.readStream.schema(ddl).json(f"{folder}/in"), f"{folder}/out", wait="2 days").trigger(availableNow=True).start()
        query.awaitTermination()
        progress.append(query.recentProgress)
    found = sd.read_pairs(spark, f"{folder}/out").groupBy("snapshot_id", "rowid").count().collect()
    assert len(found) == 12 * 15 + 11 * 4 and all(r["count"] == 1 for r in found)
    last = [p["stateOperators"][0] for p in progress[-1] if p["stateOperators"] and p["numInputRows"]][-1]
    assert last["numRowsUpdated"] == 20 + 7 and last["numRowsTotal"] <= 4 * 20
    lone = sorted((r["snapshot_id"], r["rowid"]) for r in sd.lone_halves(spark, f"{folder}/out").collect())
    assert (11, 19) in lone and (10, 19) in lone and (1, 19) not in lone and len(lone) <= 5 + 3


def test_thousands_of_markers_in_one_batch(spark, folder):
    """Ten thousand changes of shape and a change after every thousandth, delivered in the order of the log."""
    log = EventLog(spark, f"{folder}/log").create()
    n = 10_000
    markers = spark.range(1, n + 1).select(
        F.lit("schema_changed").alias("type"), F.col("id").alias("snapshot_id"), F.array(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("columns"))
    changes = spark.range(1000, n + 1, 1000).select(
        F.lit("change").alias("type"), F.col("id").alias("snapshot_id"), F.lit("insert").alias("change_type"), F.col("id").alias("rowid"), F.lit("{}").alias("row"))
    both = markers.unionByName(changes, allowMissingColumns=True).withColumn("table_id", F.lit(1)).withColumn(
        "message_id", F.concat_ws("-", "type", "snapshot_id"))
    log.publish(both, 1, n, distinct=True)
    sub, calls = Subscription(log, 1, f"{folder}/sub", start_after=0), []
    sub.on_change(lambda c: calls.extend(("change", r["rowid"]) for r in c.collect()))
    sub.on_schema_change(lambda columns: calls.append(("shape", int(columns[0][1:]))))
    sub.deliver(log.batches().collect())
    expected = [x for i in range(1, n + 1) for x in [("shape", i), *([("change", i)] if i % 1000 == 0 else [])]]
    assert calls == expected and sub.position == n + 10


def test_a_backlog_is_read_once(spark, folder):
    """How often a manifest of a micro-batch is opened does not depend on the number of steps."""
    opened = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda i: opened.add(1) or i, "long")
    batch = spark.range(1, 41).select(seen("id").alias("ordinal"))
    steps = list(in_steps(batch.filter(F.col("ordinal") > 0), "ordinal", 7))
    assert [[r["ordinal"] for r in s] for s in steps] == [list(range(a, min(a + 7, 41))) for a in range(1, 41, 7)]
    assert opened.value <= 40 * 2 * 2  # bounds and rows, the function in the filter too; not once per step
