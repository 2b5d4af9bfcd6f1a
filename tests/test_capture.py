import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from rowtide.functions.events import decode_row
from rowtide.operators.view import materialize, typed_view
from rowtide.sources import files
from rowtide.sources.lake import DuplicateKey, Lake, NoSuchTable
from rowtide.sources.log import EventLog
from rowtide.sources.manifests import HistoryRemoved
from rowtide.streaming.capture import Capture, rebuild_log

DDL = "id long, v string"


def frame(spark, rows, ddl=DDL):
    return spark.createDataFrame(rows, ddl)


def ids(log, **where):
    return [r["message_id"] for r in log.read(**where).orderBy("seq").collect()]


@pytest.fixture
def lake(spark, folder):
    return Lake(spark, f"{folder}/lake", buckets=2)


@pytest.fixture
def log(spark, folder):
    return EventLog(spark, f"{folder}/log", rows_in_order=True)


def commits_of(lake):
    return lake.commits().collect()


def test_publish_then_commit(spark, lake, log, folder):
    t = lake.create("orders", frame(spark, [(1, "a"), (2, "b")]), ["id"])
    Capture(lake, log).run_available(f"{folder}/cp", "earliest")
    rows = log.read().orderBy("seq").collect()
    assert [r["rowid"] for r in rows] == [1, 2] and {r["subject"] for r in rows} == {f"changes.{t}"}
    assert [r["seq"] for r in rows] == [1, 2]
    assert log.newest()["end_snapshot"] == 1 and log.newest()["last_seq"] == 2
    assert rows[0]["row"] == '{"id":1,"v":"a"}' and rows[0]["table"] == "orders"


def test_history_of_shapes(spark, lake, log):
    """Every kind of DDL: which ones end an epoch, and what the log says."""
    t = lake.create("orders", frame(spark, [(1, "a")], "id long, v string"), ["id"])
    fields = lake.state(t).schema.fields
    lake.alter(t, T.StructType([*fields, T.StructField("n", T.IntegerType())]))  # 2 add
    lake.replace(t, frame(spark, [(1, "a", 5)], "id long, v string, n int"))  # 3
    lake.alter(t, T.StructType([fields[0], T.StructField("n", T.LongType())]))  # 4 drop and widen
    lake.rename(t, "orders2")  # 5
    lake.alter(t, T.StructType([fields[0], T.StructField("m", T.LongType())]), renames={"m": "n"})  # 6 rename column
    lake.drop(t)  # 7
    new = lake.create("orders2", frame(spark, [(9, "z")]), ["id"])  # 8
    log.create(0)
    Capture(lake, log).publish_commits(commits_of(lake))
    assert new != t
    assert ids(log) == [
        f"{t}-1-1-insert", f"schema_changed-{t}-2", f"{t}-3-1-update_preimage", f"{t}-3-1-update_postimage",
        f"schema_changed-{t}-4", f"schema_changed-{t}-6", f"table_dropped-{t}-7", f"{new}-8-9-insert"]
    markers = {r["snapshot_id"]: r for r in log.markers().collect()}
    assert markers[2]["columns"] == ["id", "v", "n"] and markers[7]["columns"] is None
    assert markers[4]["retyped"] == ["n"] and markers[6]["table"] == "orders2"
    assert lake.columns_at(t, 1) == ["id", "v"] and lake.columns_at(t, 7) is None and lake.columns_at(99, 3) is None
    assert [tuple(r) for r in lake.read_version(t, 6).collect()] == [(1, 5)]
    assert [tuple(r) for r in lake.read_version(t, 1).collect()] == [(1, "a")]
    with pytest.raises(NoSuchTable):
        lake.append(t, frame(spark, [(2, "x")]))


def test_dropped_column_does_not_come_back(spark, lake):
    t = lake.create("t", frame(spark, [(1, "old")]), ["id"])
    key = lake.state(t).schema.fields[0]
    lake.alter(t, T.StructType([key]))
    lake.alter(t, T.StructType([key, T.StructField("v", T.StringType())]))
    assert [tuple(r) for r in lake.read_version(t).collect()] == [(1, None)]


def test_type_change_that_needs_new_contents(spark, lake, log):
    t = lake.create("t", frame(spark, [(1, "5"), (2, "6")]), ["id"])
    shape = T.StructType([lake.state(t).schema.fields[0], T.StructField("v", T.IntegerType())])
    with pytest.raises(ValueError, match="needs new contents"):
        lake.alter(t, shape)
    lake.alter(t, shape, df=frame(spark, [(1, 5), (2, 7)], "id long, v int"))
    log.create(0)
    Capture(lake, log).publish_commits(commits_of(lake))
    assert ids(log, after=2) == ["schema_changed-1-2", "1-2-2-update_preimage", "1-2-2-update_postimage"]
    assert log.markers().first()["retyped"] == ["v"]


def test_column_with_a_default_becomes_updates_after_the_marker(spark, lake, log):
    t = lake.create("t", frame(spark, [(1, "a")]), ["id"])
    shape = T.StructType([*lake.state(t).schema.fields, T.StructField("d", T.IntegerType())])
    lake.alter(t, shape, df=frame(spark, [(1, "a", 7)], "id long, v string, d int"))
    log.create(0)
    Capture(lake, log).publish_commits(commits_of(lake))
    after = materialize(log.read(), distinct=True)
    assert [dict(r["row"]) for r in after.rows.collect()] == [{"id": "1", "v": "a", "d": "7"}]
    assert not after.meta.first()["needs_reload"]


def test_only_touched_parts_are_compared(spark, folder, log):
    lake = Lake(spark, f"{folder}/wide", buckets=16)
    t = lake.create("t", spark.range(1000).select("id", F.lit("a").alias("v")), ["id"])
    state = lake.state(t)
    part = state.parts[0]
    rows = lake.read_parts(t, state.schema, [part])
    lake.replace(t, rows.withColumn("v", F.lit("b")), parts=[part])
    log.create(1)
    capture = Capture(lake, log)
    commits = [c for c in commits_of(lake) if c["snapshot_id"] == 2]
    read = {f.rsplit("/", 2)[0].rsplit("/", 1)[1] + "/" + f.split("/")[-2] for f in capture.events_of(commits).inputFiles()}
    assert read == {f"snapshot_id=1/bucket={part.split('/')[1]}", f"snapshot_id=2/bucket={part.split('/')[1]}"}
    n = rows.count()
    assert capture.publish_commits(commits_of(lake)) == 2 * n and n < 200
    assert lake.read_version(t).filter("v = 'b'").count() == n and lake.read_version(t).count() == 1000


def test_append_only_commits_need_no_join(spark, lake, log):
    t = lake.create("t", frame(spark, [(1, "a")]), ["id"])
    for i in range(2, 6):
        lake.append(t, frame(spark, [(i, "x")]))
    log.create(0)
    capture = Capture(lake, log)
    plan = capture.events_of(commits_of(lake))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert plan.count("FileScan") == 1  # five commits, one scan
    capture.publish_commits(commits_of(lake))
    assert ids(log) == [f"{t}-{i}-{i}-insert" for i in range(1, 6)]


def test_many_updates_in_one_batch(spark, lake, log):
    """Parts added and removed inside one batch, compared in one plan."""
    t = lake.create("t", frame(spark, [(i, "0") for i in range(6)]), ["id"])
    for n in range(1, 4):
        lake.replace(t, frame(spark, [(i, str(n) if i % 2 else "0") for i in range(6 - n)]))
    lake.replace(t, frame(spark, []), None)
    log.create(0)
    Capture(lake, log).publish_commits(commits_of(lake))
    after = materialize(log.read(upto=log.read(min_snapshot=0).filter("snapshot_id <= 4").count()), distinct=True)
    assert sorted((r["rowid"], r["row"]["v"]) for r in after.rows.collect()) == [(0, "0"), (1, "3"), (2, "0")]
    assert materialize(log.read(), distinct=True).rows.count() == 0


def test_equal_row_ids_of_two_tables_in_one_snapshot(spark, lake, log):
    lake.commit([lake.creation("a", frame(spark, [(1, "x")]), ["id"]), lake.creation("b", frame(spark, [(1, "y")]), ["id"])])
    log.create(0)
    Capture(lake, log).publish_commits(commits_of(lake))
    assert ids(log) == ["1-1-1-insert", "2-1-1-insert"]
    again = log.read().drop("seq", "published_at", "batch_id")
    assert log.publish(again)["rows"] == 0


def test_named_tables_and_recreation(spark, lake, log, folder):
    first = lake.create("orders", frame(spark, [(1, "a")]), ["id"])
    other = lake.create("other", frame(spark, [(1, "a")]), ["id"])
    capture = Capture(lake, log, tables=["orders"])
    capture.run_available(f"{folder}/cp", "earliest")
    lake.rename(first, "renamed")
    lake.append(first, frame(spark, [(2, "b")]))
    lake.append(other, frame(spark, [(2, "b")]))
    lake.drop(first)
    capture.run_available(f"{folder}/cp")
    lake.empty_commit()
    capture.run_available(f"{folder}/cp")
    again = lake.create("orders", frame(spark, [(5, "n")]), ["id"])
    Capture(lake, log, tables=["orders"]).run_available(f"{folder}/cp")  # a new process finds the same
    assert ids(log) == [f"{first}-1-1-insert", f"{first}-4-2-insert", f"table_dropped-{first}-6", f"{again}-8-5-insert"]
    assert log.newest()["end_snapshot"] == 8
    with pytest.raises(ValueError, match="no such table"):
        Capture(lake, EventLog(spark, f"{folder}/none"), tables=["absent"]).open()


def test_starting_points(spark, lake, folder):
    t = lake.create("t", frame(spark, [(1, "a")]), ["id"])
    lake.append(t, frame(spark, [(2, "b")]))
    for start, expected in (("latest", []), ("earliest", ["1-1-1-insert", "1-2-2-insert"]), (1, ["1-2-2-insert"])):
        log = EventLog(spark, f"{folder}/log-{start}")
        Capture(lake, log).run_available(f"{folder}/cp-{start}", start)
        assert ids(log) == expected
    log = EventLog(spark, f"{folder}/log-latest")
    lake.append(t, frame(spark, [(3, "c")]))
    Capture(lake, log).run_available(f"{folder}/cp-latest")
    assert ids(log) == ["1-3-3-insert"]


class Crash(Exception):
    pass


@pytest.mark.parametrize("where", ["before write", "before manifest", "after manifest"])
def test_crash_loses_and_repeats_nothing(spark, lake, log, folder, monkeypatch, where):
    t = lake.create("t", frame(spark, [(1, "a"), (2, "b")]), ["id"])
    capture = Capture(lake, log)
    capture.run_available(f"{folder}/cp", "earliest")
    lake.replace(t, frame(spark, [(1, "c"), (3, "d")]))
    put, events_of = log._put, capture.events_of

    def fail(*args):
        raise Crash()

    def put_then_fail(manifest):
        put(manifest)
        raise Crash()

    if where == "before write":
        monkeypatch.setattr(capture, "events_of", fail)
    else:
        monkeypatch.setattr(log, "_put", fail if where == "before manifest" else put_then_fail)
    with pytest.raises(Exception, match="Crash"):
        capture.run_available(f"{folder}/cp")
    assert log.newest()["end_snapshot"] == (2 if where == "after manifest" else 1)
    monkeypatch.undo()
    lake.append(t, frame(spark, [(4, "e")]))
    checkpoint = f"{folder}/cp" if where != "before manifest" else f"{folder}/fresh"  # also without its checkpoint
    Capture(lake, log).run_available(checkpoint)
    Capture(lake, log).run_available(checkpoint)
    assert sorted(ids(log)) == [
        "1-1-1-insert", "1-1-2-insert", "1-2-1-update_postimage", "1-2-1-update_preimage", "1-2-2-delete", "1-2-3-insert",
        "1-3-4-insert"]
    assert [r["seq"] for r in log.read().orderBy("seq").collect()] == list(range(1, 8))
    log.remove_leftovers()
    assert log.read().count() == 7


def test_manifest_out_of_order_waits(spark, lake, log, folder):
    t = lake.create("t", frame(spark, [(1, "a")]), ["id"])
    lake.append(t, frame(spark, [(2, "b")]))
    lake.append(t, frame(spark, [(3, "c")]))
    late = files.manifest_path(lake.commits_path, 2)
    row = files.read_json(late)
    files.delete(late)
    Capture(lake, log).run_available(f"{folder}/cp", "earliest")
    assert ids(log) == ["1-1-1-insert"]
    files.write_json(late, row)
    Capture(lake, log).run_available(f"{folder}/cp")
    assert ids(log) == ["1-1-1-insert", "1-2-2-insert", "1-3-3-insert"]


def test_history_removed_before_capture(spark, lake, log):
    t = lake.create("t", frame(spark, [(1, "a")]), ["id"])
    lake.append(t, frame(spark, [(2, "b")]))
    log.create(0)
    files.delete(files.manifest_path(lake.commits_path, 1))
    with pytest.raises(HistoryRemoved):
        Capture(lake, log).open()
    with pytest.raises(HistoryRemoved):
        Capture(lake, log).publish_commits(commits_of(lake))


@pytest.mark.parametrize("ordered", [True, False])
def test_ten_thousand_rows_in_one_commit(spark, lake, folder, ordered):
    log = EventLog(spark, f"{folder}/log", rows_in_order=ordered).create(0)
    t = lake.create("t", spark.range(10_000).select("id", F.lit("x").alias("v")), ["id"])
    lake.replace(t, spark.range(5000).select("id", F.lit("y").alias("v")))
    assert Capture(lake, log).publish_commits(commits_of(lake)) == 10_000 + 5_000 * 2 + 5_000
    found = log.read().groupBy("snapshot_id").agg(F.min("seq"), F.max("seq"), F.countDistinct("seq"), F.countDistinct("rowid"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 10_000, 10_000, 10_000), (2, 10_001, 25_000, 15_000, 10_000)]
    if ordered:
        places = [r["rowid"] for r in log.read().filter("snapshot_id = 1").orderBy("seq").collect()]
        assert places == sorted(places)


def test_chunks_of_commits(spark, lake, log):
    t = lake.create("t", frame(spark, [(0, "a")]), ["id"])
    for i in range(1, 5):
        lake.append(t, frame(spark, [(i, "b")]))
    log.create(0)
    Capture(lake, log, max_commits=2).publish_commits(commits_of(lake))
    batches = log.batches().orderBy("ordinal").collect()
    assert [(b["start_snapshot"], b["end_snapshot"], b["first_seq"], b["last_seq"]) for b in batches[1:]] == [
        (1, 2, 1, 2), (3, 4, 3, 4), (5, 5, 5, 5)]


def test_key_must_be_unique(spark, lake):
    with pytest.raises(DuplicateKey):
        lake.create("t", frame(spark, [(1, "a"), (1, "b")]), ["id"])


def test_payload_types(spark, lake, log):
    values = spark.sql("""
      SELECT 1L AS id, CAST(1.50 AS DECIMAL(5,2)) AS c, DATE'2026-01-02' AS d, TIMESTAMP_NTZ'2026-01-02 03:04:05' AS t,
        TIMESTAMP_NTZ'2026-01-02 03:04:05.25' AS f, CAST('NaN' AS DOUBLE) AS x, CAST(NULL AS INT) AS n, true AS b,
        array(named_struct('m', CAST(2 AS DECIMAL(3,1)))) AS l, 'q"\\'.x' AS `odd.name`, 'st' AS snapshot_time, 'tn' AS table_name""")
    lake.create("db.t'1", values, ["id"])
    log.create(0)
    Capture(lake, log).publish_commits(commits_of(lake))
    row = log.read().select(decode_row("row").alias("m"), "table").first()
    assert row["table"] == "db.t'1"
    assert dict(row["m"]) == {
        "id": "1", "c": "1.50", "d": "2026-01-02", "t": "2026-01-02 03:04:05", "f": "2026-01-02 03:04:05.250000", "x": "NaN",
        "n": None, "b": "true", "l": '[{"m":"2.0"}]', "odd.name": "q\"'.x", "snapshot_time": "st", "table_name": "tn"}


def test_retention_and_rebuild(spark, lake, log, folder):
    t = lake.create("t", frame(spark, [(1, "a")]), ["id"])
    for i in range(2, 5):
        lake.append(t, frame(spark, [(i, "b")]))
    log.create(0)
    Capture(lake, log, max_commits=1).publish_commits(commits_of(lake))
    assert log.retain(max_rows=2) == 3 and ids(log) == ["1-3-3-insert", "1-4-4-insert"]
    assert tuple(log.bounds().first()) == (3, 4) and log.first_seq() == 3
    assert log.retain(max_age=dt.timedelta(days=1)) == 0
    assert log.retain(max_age=dt.timedelta(0), now=dt.datetime.now(dt.timezone.utc) + dt.timedelta(days=1)) == 1
    assert log.newest()["end_snapshot"] == 4  # the cursor stays
    rebuilt = rebuild_log(lake, f"{folder}/rebuilt", f"{folder}/rcp")
    assert ids(rebuilt) == [f"1-{i}-{i}-insert" for i in range(1, 5)] and rebuilt.newest()["log_id"] != log.newest()["log_id"]


def test_readers_touch_the_log_only(spark, lake, log):
    lake.create("t", frame(spark, [(1, "a")]), ["id"])
    log.create(0)
    Capture(lake, log).publish_commits(commits_of(lake))
    read = log.read(table_id=1).inputFiles()
    assert any("/log/events/" in f for f in read) and all("/log/events/" in f or "/log/batches/" in f for f in read)


def test_pruned_by_the_manifests_and_markers_apart(spark, lake, log):
    t = lake.create("t", frame(spark, [(1, "a")]), ["id"])
    other = lake.create("u", frame(spark, [(1, "a")]), ["id"])
    lake.append(t, frame(spark, [(2, "b")]))
    lake.drop(other)
    lake.append(t, frame(spark, [(3, "c")]))
    log.create(0)
    Capture(lake, log, max_commits=1).publish_commits(commits_of(lake))
    assert [(r["marked"], r["tables"]) for r in log.batches().orderBy("ordinal").collect()] == [
        (False, []), (False, [1]), (False, [2]), (False, [1]), (True, [2]), (False, [1])]
    late = log.read(table_id=1, after=2)
    assert "dynamicpruning" in late._jdf.queryExecution().toString().lower() and ids(log, table_id=1, after=2) == ["1-3-2-insert", "1-5-3-insert"]
    # Files with changes are gone: markers do not need them.
    for path in [r["path"] for r in log.batches().filter("rows > 0").collect()]:
        files.delete(f"{log.events_path}/{path}")
    assert [(r["type"], r["table_id"], r["snapshot_id"]) for r in log.markers().collect()] == [("table_dropped", 2, 4)]
    assert log.markers(table_id=1).count() == 0


def test_key_columns_by_id(spark, lake, log, folder):
    t = lake.create("t", frame(spark, [(1, "a"), (2, "b")]), ["id"])
    id_, v = lake.state(t).schema.fields
    lake.alter(t, T.StructType([T.StructField("k", T.LongType()), v]), renames={"k": "id"})
    assert lake.state(t).key == ["k"]
    lake.append(t, spark.createDataFrame([(3, "c")], "k long, v string"))
    with pytest.raises(DuplicateKey):
        lake.append(t, spark.createDataFrame([(1, "c")], "k long, v string"))
    with pytest.raises(ValueError, match="cannot be dropped"):
        lake.alter(t, T.StructType([v]))
    pair = lake.create("u", frame(spark, [(1, "a")]), ["id", "v"])
    with pytest.raises(ValueError, match="cannot be renamed"):
        lake.alter(pair, T.StructType([T.StructField("k", T.LongType()), v]), renames={"k": "id"})
    log.create(0)
    Capture(lake, log).publish_commits(commits_of(lake))
    assert sorted(r["rowid"] for r in log.changes(table_id=t).collect()) == [1, 2, 3]


def test_types_that_cannot_be_compared(spark, lake, log):
    """Maps, a struct with a field that is never null, nested binary values: equal rows give nothing."""
    make = lambda m: spark.sql(f"SELECT CAST(id AS LONG) AS id, {m} AS m, array(named_struct('a', X'00ff', 't', TIMESTAMP '2026-01-02 03:04:05')) AS s, X'01fe' AS b FROM range(3)")
    t = lake.create("t", make("map('x', map(1, 2), 'y', map(3, 4))"), ["id"])
    lake.replace(t, make("map('y', map(3, 4), 'x', if(id = 1, map(1, 5), map(1, 2)))"))
    lake.alter(t, T.StructType([*lake.state(t).schema.fields, T.StructField("w", T.MapType(T.StringType(), T.StringType()))]))
    log.create(0)
    Capture(lake, log).publish_commits(commits_of(lake))
    assert [r["rowid"] for r in log.changes(min_snapshot=2).filter("snapshot_id = 2").orderBy("seq").collect()] == [1, 1]
    rows = {r["id"]: r for r in typed_view(materialize(log.read(), distinct=True).rows, lake.state(t).schema).collect()}
    assert rows[1]["m"] == {"y": {3: 4}, "x": {1: 5}} and rows[0]["m"] == {"y": {3: 4}, "x": {1: 2}} and rows[0]["w"] is None
    assert bytes(rows[0]["b"]) == b"\x01\xfe" and bytes(rows[0]["s"][0]["a"]) == b"\x00\xff"
    assert rows[0]["s"][0]["t"] == dt.datetime(2026, 1, 2, 3, 4, 5)
