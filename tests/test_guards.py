"""What must fail loudly instead of losing rows."""

import pytest
from pyspark.sql import functions as F

from rowtide.operators.pairs import feed
from rowtide.settings import check_path
from rowtide.sources import files
from rowtide.sources.lake import DuplicateKey, Lake, NameInUse, NullKey
from rowtide.sources.log import EventLog
from rowtide.sources.sql import register_views
from rowtide.sources.viewstore import ViewStore
from rowtide.streaming.capture import Capture
from rowtide.streaming.dedup import lone_halves, pair_stream, read_pairs
from rowtide.streaming.follow import Follower


def frame(spark, rows, ddl="id long, v string"):
    return spark.createDataFrame(rows, ddl)


def test_keys_that_share_a_hash_are_two_rows(spark, folder):
    keys = [(1, 1, "a"), (2, 196073448242816449, "b")]
    rows = frame(spark, keys, "a long, b long, v string")
    assert rows.select(F.xxhash64("a", "b")).distinct().count() == 1
    lake, log = Lake(spark, f"{folder}/lake"), EventLog(spark, f"{folder}/log").create(0)
    table = lake.create("t", rows, ["a", "b"])
    lake.replace(table, frame(spark, [(1, 1, "a"), (2, 196073448242816449, "c")], "a long, b long, v string"))
    Capture(lake, log).publish_commits(lake.commits().collect())
    reader = Follower(log, table, ViewStore(spark, f"{folder}/view"))
    reader.open(0)
    reader.apply(log.batches().collect())
    assert sorted(r["row"]["v"] for r in reader.rows().collect()) == ["a", "c"]
    assert log.read().count() == 4 and log.read().select("message_id").distinct().count() == 4
    before = log.newest()["rows"]
    log.publish(log.read().drop("seq", "published_at", "batch_id"))  # every id is known
    assert before == 4 and log.newest()["rows"] == 0


def test_tables_created_together_get_their_own_ids(spark, folder):
    lake = Lake(spark, folder)
    one, two = lake.creation("p", frame(spark, [(1, "x")]), ["id"]), lake.creation("q", frame(spark, [(2, "y")]), ["id"])
    lake.commit([one, two])
    assert one.table_id != two.table_id
    assert lake.read_version(one.table_id).first()["id"] == 1 and lake.read_version(two.table_id).first()["id"] == 2
    with pytest.raises(ValueError):
        lake.commit([lake.appending(one.table_id, frame(spark, [(5, "z")])), lake.renaming(one.table_id, "r")])


def test_keys_of_the_table_count_too(spark, folder):
    lake = Lake(spark, folder, buckets=4)
    table = lake.create("t", frame(spark, [(i, "x") for i in range(20)]), ["id"])
    with pytest.raises(DuplicateKey):
        lake.append(table, frame(spark, [(3, "again"), (99, "new")]))
    lake.append(table, frame(spark, [(99, "new")]))
    assert lake.read_version(table).count() == 21
    lake.replace(table, frame(spark, [(3, "y")]))
    assert lake.read_version(table).count() == 1


def test_names_are_unique_and_keys_are_there(spark, folder):
    lake = Lake(spark, folder)
    table = lake.create("x", frame(spark, [(1, "x")]), ["id"])
    with pytest.raises(NameInUse):
        lake.create("x", frame(spark, [(1, "x")]), ["id"])
    other = lake.create("y", frame(spark, [(1, "x")]), ["id"])
    with pytest.raises(NameInUse):
        lake.rename(other, "x")
    lake.commit([lake.dropping(table), lake.renaming(other, "x")])
    assert lake.table_id("x") == other
    with pytest.raises(NullKey):
        lake.append(other, frame(spark, [(None, "n")]))


def test_one_writer_wins(folder):
    path = files.manifest_path(folder, 1)
    files.write_json(path, [{"a": 1}], new=True)
    with pytest.raises(files.AlreadyThere):
        files.write_json(path, [{"a": 2}], new=True)
    assert files.read_json(path) == [{"a": 1}] and files.manifest_numbers(folder) == [1]


def test_paths_without_a_file_system(spark):
    conf = spark._jsc.hadoopConfiguration()
    old = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "hdfs://store:8020")
        with pytest.raises(ValueError):
            check_path(spark, "/shared/lake")
        assert check_path(spark, "hdfs://store:8020/shared/") == "hdfs://store:8020/shared"
    finally:
        conf.set("fs.defaultFS", old or "file:///")
    assert check_path(spark, "/shared/lake/") == "/shared/lake"


def test_feed_keeps_negative_row_ids(log_of):
    found = feed(log_of([("insert", -7, "{}"), ("insert", -1, "{}"), ("schema_changed", ["id"])])).collect()
    assert [(r["kind"], r["rowid"]) for r in found] == [("schema_changed", None), ("insert", -1), ("insert", -7)]


def test_late_copies_of_a_pair(spark, log_of, folder):
    halves = log_of([("update_preimage", 1, '{"v":1}', 1), ("update_postimage", 1, '{"v":2}', 1)])
    columns = ["seq", "type", "table_id", "snapshot_id", "rowid", "change_type", "row"]
    first = halves.select(*columns)
    first.write.parquet(f"{folder}/in/1")
    source = spark.readStream.schema(first.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    run = lambda: pair_stream(source, f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    run()
    first.write.parquet(f"{folder}/in/2")  # both again
    run()
    first.filter("change_type = 'update_preimage'").write.parquet(f"{folder}/in/3")  # one again
    run()
    assert read_pairs(spark, f"{folder}/out").count() == 1 and lone_halves(spark, f"{folder}/out").count() == 0


def test_views_of_one_name_are_refused(spark, folder):
    lake, log = Lake(spark, f"{folder}/lake"), EventLog(spark, f"{folder}/log").create(0)
    lake.create("a.b", frame(spark, [(1, "dot")]), ["id"])
    lake.create("a_b", frame(spark, [(1, "bar")]), ["id"])
    register_views(spark, lake, log)
    assert [spark.sql(f"SELECT v FROM `{n}`").first()[0] for n in ("a.b", "a_b")] == ["dot", "bar"]
    lake.create("log", frame(spark, [(1, "x")]), ["id"])
    with pytest.raises(ValueError):
        register_views(spark, lake, log)


def test_copies_with_other_payloads_give_one_result(spark, log_of, folder):
    events = log_of([("insert", 1, '{"v":1}', 1), ("insert", 1, '{"v":2}', 1)]).drop("seq")
    kept = set()
    for i, order in enumerate((1, -1)):
        log = EventLog(spark, f"{folder}/{i}").create(0)
        log.publish(events.orderBy(F.col("row") if order > 0 else F.desc("row")))
        kept.add(log.read().first()["row"])
    assert len(kept) == 1


def test_delivery_times_are_those_of_the_manifest(spark, log_of, folder):
    log = EventLog(spark, folder).create(0)
    log.publish(log_of([("insert", 1, "{}", 1)]).drop("seq"))
    row = log.delivery().join(log.read().select("seq", F.col("published_at").alias("written_at")), "seq").first()
    assert row["published_at"] >= row["written_at"]
    assert log.batches().filter("rows > 0").first()["published_at"] == row["published_at"]


def test_retention_by_bytes_and_log_size(spark, log_of, folder):
    log = EventLog(spark, folder).create(0)
    for snapshot in (1, 2, 3):
        log.publish(log_of([("insert", snapshot, "{}", snapshot)]).drop("seq"), snapshot, snapshot)
    held = log.size().first()
    sizes = [r["bytes"] for r in log.batches().filter("rows > 0").orderBy("ordinal").collect()]
    assert held["batches"] == 3 and held["rows"] == 3 and held["bytes"] == sum(sizes) > 0
    log.retain(max_bytes=sizes[1] + sizes[2])
    assert log.size().first()["bytes"] == sizes[1] + sizes[2] and log.read().count() == 2


def test_state_reads_new_manifests_only(spark, folder, monkeypatch):
    lake = Lake(spark, folder)
    table = lake.create("t", frame(spark, [(1, "x")]), ["id"])
    opened, real = [], files.read_json
    monkeypatch.setattr(files, "read_json", lambda path: opened.append(path) or real(path))
    for i in range(2, 6):
        lake.append(table, frame(spark, [(i, "x")]))
    assert len(opened) == len(set(opened))
    assert Lake(spark, folder).state(table).parts == lake.state(table).parts == lake.state(table, 5).parts


def test_id_filters_spare_batches(spark, folder):
    """Late copies open the batches that may hold them only; the filter misses no id and finds few others."""
    from pathlib import Path

    from rowtide.sources.idfilter import IdFilters, shards_for

    log = EventLog(spark, f"{folder}/log").create()
    events = lambda low, high: spark.range(low, high).select(
        F.lit("change").alias("type"), F.lit(1).alias("table_id"), F.lit("insert").alias("change_type"), F.col("id").alias("rowid"),
        F.lit(1).alias("snapshot_id"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id"), F.lit("{}").alias("row"))
    for low in range(0, 20_000, 5_000):
        log.publish(events(low, low + 5_000), 1, 1, distinct=True)
    assert log.publish(events(7_000, 7_010).unionByName(events(90_000, 90_001)), 1, 1)["rows"] == 1
    ids = spark.range(30_000, 40_000).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id"))
    batches = log.batches().filter("rows > 0").select(F.regexp_replace("path", "^batch=", "").alias("batch"), "rows")
    filters = IdFilters(spark, f"{log.path}/ids")
    one = lambda i: ids.limit(1).select(F.lit(f"m{i}").alias("message_id"))
    tokens = [r["batch"] for r in batches.orderBy("batch").collect()]
    for i in (0, 4_999, 5_000, 12_345, 19_999):
        assert tokens[i // 5_000] in {r["batch"] for r in filters.holding(one(i), batches).collect()}
    wrong = sum(filters.holding(one(i), batches).count() for i in range(30_000, 30_010))
    assert wrong <= 5 and shards_for(1) == 1 and shards_for(5_000) == 2 and shards_for(1_000_000) == 512
    # Batches that hold none of the late ids cannot be read any more; a publish of copies from the second one can go on.
    held = {r["batch"] for r in filters.holding(events(7_000, 7_003).select("message_id"), batches).collect()}
    assert tokens[1] in held and len(held) < 4
    for token in set(tokens[:4]) - held:  # the fifth has no filter yet
        for path in Path(f"{log.events_path}/batch={token}").rglob("*.parquet"):
            path.write_bytes(b"not parquet")
    assert log.publish(events(7_000, 7_003), 1, 1)["rows"] == 0


def test_id_filters_are_made_and_asked_in_small_parts(spark, folder, never_broadcast):
    """An id has its bits in one bitmap, and no batch is gathered in one task to make its filter."""
    from rowtide.sources.idfilter import _BITS, IdFilters, places

    ids = spark.range(3_000).select(
        F.when(F.col("id") < 2_900, "a").otherwise("b").alias("batch"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("message_id"))
    found = ids.select(places("message_id", F.lit(8).cast("long")).alias("p")).select(
        F.size(F.array_distinct(F.transform("p", lambda p: F.floor((p - 1) / _BITS)))).alias("n"),
        F.array_min("p").alias("low"), F.array_max("p").alias("high"))
    assert found.agg(F.max("n"), F.min("low") >= 1, F.max("high") <= 8 * _BITS).first() == (1, True, True)
    filters = IdFilters(spark, f"{folder}/ids")
    plan = filters._bitmaps(ids, [("a", 8), ("b", 1)])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(batch" not in plan and "hashpartitioning(filter" in plan
    sizes = spark.createDataFrame([("a", 2_900), ("b", 100)], "batch string, rows long")
    filters.build(sizes, ids)
    held = lambda low, high: {r["batch"] for r in filters.holding(ids.offset(low).limit(high - low).select("message_id"), sizes).collect()}
    assert held(0, 2_900) >= {"a"} and held(2_900, 3_000) >= {"b"} and held(0, 3_000) == {"a", "b"}
