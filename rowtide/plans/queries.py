"""The queries of the driver contract: name → function of (spark, folder of the tables)."""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowtide.functions.events import (
    CHANGE, SCHEMA_CHANGED, clock_text, decode_row, describe, encode_row, iso_text, quoted_name, render_line, successor_name,
)
from rowtide.functions.rows import diff_fields as changed_fields, value_text
from rowtide.operators import epochs as ep, metrics, pairs, positions, view
from rowtide.operators.dedup import first_copies, not_in_log
from rowtide.operators.diff import diff_tables, duplicate_keys as repeated_keys, inserts, with_rowid
from rowtide.operators.sequence import assign_seq, look_along, union_log
from rowtide.plans import workload as w
from rowtide.settings import local_table, scratch_dir
from rowtide.sources import files
from rowtide.sources.lake import Lake
from rowtide.sources.log import EventLog
from rowtide.sources.manifests import HistoryRemoved
from rowtide.sources.sql import register_views, run_sql
from rowtide.sources.viewstore import ViewStore
from rowtide.streaming import dedup as sd
from rowtide.streaming.capture import Capture, rebuild_log
from rowtide.streaming.follow import Follower
from rowtide.streaming.subscribe import Subscription, activity_feed as newest_entries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


_made: dict[tuple, object] = {}


def _once(fn):
    """Lakes and logs several queries read are written once per application and folder."""

    @wraps(fn)
    def made(spark: SparkSession, sf: str):
        key = (fn.__name__, spark.sparkContext.applicationId, sf)
        if key not in _made:
            _made[key] = fn(spark, sf)
        return _made[key]

    return made


def _n(column="*"):
    return F.count(F.lit(1) if column == "*" else column).cast("long")


# --- diff ---


@query
def diff_orders(spark, sf):
    return w.orders_diff(spark, sf).select(
        "rowid", "change_type", F.col("row.o_totalprice").alias("price"), F.col("row.o_orderstatus").alias("status"))


@query
def diff_counts(spark, sf):
    return w.orders_diff(spark, sf).groupBy("change_type").agg(_n().alias("events"))


@query
def diff_append_only(spark, sf):
    loaded = inserts(with_rowid(w.orders_v2(spark, sf), ["o_orderkey"]))
    return loaded.select("rowid", "change_type", F.col("row.o_totalprice").alias("price"))


@query
def diff_composite_key(spark, sf):
    """Changes of a table with two key columns, whose row ids are hashes."""
    now = w.table(spark, sf, "conversations")
    before = now.filter((F.col("role") != "assistant") | (F.length("text") > 200))
    after = now.filter((F.col("role") != "user") | (F.length("text") > 20)).withColumn(
        "text", F.when(F.col("role") == "user", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    changes = diff_tables(before, after, ["conv_id", "turn"])
    return changes.select("change_type", "rowkey", "row.conv_id", "row.turn", "row.role", "row.text")


@query
def duplicate_keys(spark, sf):
    found = repeated_keys(w.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    return found.select("l_orderkey", "l_linenumber", F.col("count").cast("long").alias("copies"))


# --- events ---


@query
def event_envelope(spark, sf):
    row = decode_row("row")
    return w.orders_changes(spark, sf).select(
        "type", "subject", "message_id", "table_id", "table", "snapshot_id", "rowid", "change_type",
        row["o_orderdate"].alias("order_date"), row["o_orderstatus"].alias("order_status"),
        row["o_totalprice"].cast("double").alias("order_price"), row["c_name"].alias("customer"),
        value_text(row["c_mktsegment"]).alias("segment"),
    )


@query
def nested_rows(spark, sf):
    """Array payloads keep their elements through the log."""
    rows = with_rowid(w.table(spark, sf, "embeddings"), ["vec_id"])
    encoded = rows.select("rowid", decode_row(encode_row(rows, "row")).alias("m"))
    items = F.from_json(F.col("m")["embedding"], "array<float>")
    return encoded.select("rowid", F.col("m")["label"].cast("int").alias("label"), F.posexplode(items).alias("place", "item")).select(
        "rowid", "label", F.col("place").cast("long").alias("place"), "item")


@query
def document_rows(spark, sf):
    """Long texts pass through the JSON of the log unchanged."""
    rows = with_rowid(w.table(spark, sf, "documents"), ["doc_id"])
    encoded = rows.select("rowid", decode_row(encode_row(rows, "row")).alias("m"))
    return encoded.select(
        F.col("rowid").alias("doc_id"), F.col("m")["text"].alias("text"), F.col("m")["lang"].alias("lang"),
        F.col("m")["n_chars"].cast("long").alias("n_chars"))


@query
def render_lines(spark, sf):
    events = w.table(spark, sf, "events")
    lines = events.select(
        F.lit(CHANGE).alias("type"), w.kind_of(F.col("event_type")).alias("change_type"),
        (F.col("event_id") + 1).alias("snapshot_id"), "event_id", "ts",
        F.to_json(F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind"))).alias("row"))
    return lines.select(
        "event_id", render_line().alias("line"), clock_text("ts").alias("clock"), iso_text("ts").alias("iso"),
        successor_name(F.lit("reader"), F.col("snapshot_id").cast("string")).alias("successor"),
        quoted_name(F.concat(F.lit("main.t"), F.col("event_id").cast("string"))).alias("quoted"))


@query
def dump_log(spark, sf):
    events = w.table(spark, sf, "events").select(
        (F.col("event_id") + 1).alias("seq"), F.when(w.is_drop(), "table_dropped").when(
            F.col("event_type") == "view", "schema_changed").otherwise(CHANGE).alias("type"),
        F.concat(F.lit("changes."), F.col("user_id").cast("string")).alias("subject"),
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("table"),
        (F.col("event_id") + 1).alias("snapshot_id"), w.kind_of(F.col("event_type")).alias("change_type"),
        F.to_json(F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind"))).alias("row"))
    return describe(events).orderBy("seq")


# --- log ---


@query
def log_dedup(spark, sf):
    log = w.event_log(spark, sf)
    late = log.withColumn("seq", F.col("seq") + F.lit(1_000_000_000_000))
    return first_copies(log.unionByName(late)).select("message_id", "seq", "table_id", "rowid", "change_type")


@query
def dedup_publish(spark, sf):
    """New events against those the log holds already: here the changes, without the deletes."""
    log = w.event_log(spark, sf)
    return not_in_log(log, log.filter(F.col("change_type") != "delete")).select("message_id", "seq")


@query
def log_seq(spark, sf):
    commits = w.event_commits(spark, sf)
    markers = ep.markers_of(ep.epochs(commits)).withColumn("snapshot_id", F.col("snapshot_id"))
    changes = w.event_log(spark, sf).drop("seq")
    marked = markers.withColumn("message_id", F.concat_ws("-", "type", "table_id", "snapshot_id"))
    numbered, _ = assign_seq(union_log(changes, marked.drop("columns")), total_order=True)
    return numbered.select("seq", "message_id")


@_once
def _published(spark, sf) -> EventLog:
    """``events`` as a log on disk, published in three batches."""
    log = EventLog(spark, scratch_dir(spark, "log")).create()
    events = w.event_log(spark, sf).drop("seq")
    top = w.table(spark, sf, "events").agg(F.max("event_id")).first()[0] + 1
    cuts = [0, top // 3, 2 * top // 3, top]
    for low, high in zip(cuts, cuts[1:]):
        log.publish(events.filter((F.col("snapshot_id") > low) & (F.col("snapshot_id") <= high)), low + 1, high)
    return log


@query
def replay_from(spark, sf):
    log = _published(spark, sf)
    return log.read(table_id=2, after=log.head() // 2).select("seq", "message_id", "snapshot_id", "rowid", "change_type")


@_once
def _ending(spark, sf) -> EventLog:
    """A log of twenty tables, some of which are dropped, published in three batches."""
    log = EventLog(spark, scratch_dir(spark, "ending")).create()
    events = w.ending_log(spark, sf).select(
        (F.col("table_id") % 20).alias("table_id"), F.col("seq").alias("snapshot_id"), F.col("seq").alias("rowid"), "type",
        F.concat_ws("-", "type", "seq").alias("message_id"), F.when(F.col("type") == CHANGE, "insert").alias("change_type"))
    top = events.agg(F.max("snapshot_id")).first()[0]
    for low, high in ((0, top // 3), (top // 3, 2 * top // 3), (2 * top // 3, top)):
        log.publish(events.filter((F.col("snapshot_id") > low) & (F.col("snapshot_id") <= high)), low + 1, high)
    return log


@query
def replay_to_drop(spark, sf):
    """Events of every table up to its drop, with the drops found in the side table of markers."""
    return _ending(spark, sf).live().select("seq", "type", "table_id", "change_type")


@query
def marker_index(spark, sf):
    """All markers of the log, from the side table."""
    return _ending(spark, sf).markers().select("seq", "type", "table_id")


@query
def publish_again(spark, sf):
    """The whole log published a second time: nothing may be stored twice."""
    log = EventLog(spark, scratch_dir(spark, "again")).create()
    events = w.event_log(spark, sf).drop("seq")
    log.publish(events.unionByName(events))
    log.publish(events)
    return log.read().groupBy("table_id").agg(
        _n().alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query
def publish_late_copies(spark, sf):
    """Copies of every seventh event of the first batch, published late with new events: only the new ones are stored."""
    log = _published.__wrapped__(spark, sf)  # a log of its own, as it is changed here
    events = w.event_log(spark, sf).drop("seq")
    top = events.agg(F.max("snapshot_id")).first()[0]
    late = events.filter((F.col("snapshot_id") <= top // 3) & (F.col("snapshot_id") % 7 == 0))
    new = events.filter(F.col("snapshot_id") % 5 == 0).withColumn("snapshot_id", F.col("snapshot_id") + top).withColumn(
        "message_id", F.concat_ws("-", F.lit("new"), "message_id"))
    log.publish(late.unionByName(new))
    return log.read().groupBy("table_id").agg(
        _n().alias("events"), F.countDistinct("message_id").alias("ids"), F.min("seq").alias("first_seq"))


@query
def log_bounds(spark, sf):
    return _published(spark, sf).bounds()


@query
def retained_bounds(spark, sf):
    """Bounds after the oldest third was removed."""
    log = EventLog(spark, scratch_dir(spark, "retained")).create()
    events = w.event_log(spark, sf).drop("seq")
    top = w.table(spark, sf, "events").agg(F.max("event_id")).first()[0] + 1
    third = top // 3
    log.publish(events.filter(F.col("snapshot_id") <= third), 1, third)
    log.publish(events.filter(F.col("snapshot_id") > third), third + 1, top)
    log.retain(from_seq=third + 1)
    return log.bounds().withColumn("held", F.lit(log.read().count()).cast("long"))


@query
def too_old(spark, sf):
    events = w.table(spark, sf, "events")
    bounds = events.agg(
        (F.min(F.when(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"), F.col("event_id"))) + 1).alias("f"),
        (F.max("event_id") + 1).alias("l")).first()
    readers = events.groupBy("user_id", "event_type").agg((F.min("event_id") + 1).alias("last_seq"))
    return positions.position_status(readers, bounds["f"], bounds["l"]).withColumnRenamed("position_status", "state")


@query
def batch_counts(spark, sf):
    log = w.event_log(spark, sf).withColumn("batch_id", F.unix_date(F.col("snapshot_time").cast("date")).cast("long"))
    return metrics.batch_counts(log)


@query
def event_counts(spark, sf):
    return metrics.event_counts(w.event_log(spark, sf))


# --- view ---


@query
def materialize_events(spark, sf):
    after = view.materialize(w.event_log(spark, sf))
    return after.rows.select("table_id", "rowid", F.col("row")["value"].cast("double").alias("value"), "seq")


@query
def materialize_orders(spark, sf):
    log = w.orders_log(spark, sf).filter(F.col("table_id") == w.ORDERS_ID)
    rows = view.materialize(log, distinct=True).rows
    return view.typed_view(rows, w.orders_v2(spark, sf).schema).drop("rowid")


@query
def late_copies(spark, sf):
    """Old events delivered again at the end must not move the view back."""
    log = w.event_log(spark, sf)
    again = log.withColumn("seq", F.col("seq") + F.lit(1_000_000_000_000))
    after = view.materialize(log.unionByName(again))
    return after.rows.select("table_id", "rowid", F.col("row")["kind"].alias("kind"), "seq")


@query
def view_in_order(spark, sf):
    rows = view.fold(w.event_log(spark, sf))
    return view.in_order(rows).select("table_id", "rowid", "seq")


@query
def stop_at_drop(spark, sf):
    return view.stop_at_drop(w.ending_log(spark, sf)).select("seq", "table_id", "type")


@query
def marker_delta(spark, sf):
    markers = w.marker_log(spark, sf)
    none = local_table(spark, [], "table_id long, shape_seq long, shape array<string>")
    delta = view.marker_delta(markers, none)
    text = lambda c: F.concat_ws(",", F.sort_array(c))
    return delta.select(
        "table_id", "seq", text("known").alias("known"), text(F.coalesce("removed", F.array())).alias("removed"),
        text(F.coalesce("added", F.array())).alias("added"), "skip")


@query
def reshape(spark, sf):
    rows = view.materialize(w.mixed_log(spark, sf), distinct=True).rows
    has = lambda name: F.map_contains_key("row", name)
    return rows.select(
        "table_id", "rowid", has("id").alias("has_id"), has("amount").alias("has_amount"),
        has("priority").alias("has_priority"), F.col("row")["amount"].cast("long").alias("amount"))


@query
def needs_reload(spark, sf):
    meta = view.materialize(w.mixed_log(spark, sf), distinct=True).meta
    return meta.select(
        "table_id", "last_seq", F.concat_ws(",", F.sort_array("columns")).alias("columns"), "needs_reload", "ended")


@query
def first_shapes(spark, sf):
    found = view.first_shapes(w.mixed_log(spark, sf))
    return found.select("table_id", "shape_seq", F.concat_ws(",", "shape").alias("shape"))


@query
def last_table_name(spark, sf):
    log = w.event_log(spark, sf).withColumn(
        "table", F.when(F.col("change_type") == "delete", "").otherwise(F.concat_ws("_", "table", "change_type")))
    return view.last_table_name(log)


@query
def header_columns(spark, sf):
    after = view.materialize(w.mixed_log(spark, sf), distinct=True)
    return view.header_columns(after.rows, after.meta).select(
        "table_id", F.concat_ws(",", F.sort_array("header")).alias("header"))


@query
def reader_status(spark, sf):
    log = w.event_log(spark, sf)
    after = view.materialize(log)
    received = log.groupBy("table_id").agg(_n().alias("received"))
    head = log.agg(F.max("seq")).first()[0]
    return metrics.reader_status(
        after.meta, received, view.last_table_name(log), after.rows, head, w.PREFIX, online=True
    ).drop("columns", "error")


# --- epochs ---


@query
def epochs(spark, sf):
    return ep.epochs(w.event_commits(spark, sf)).select("table_id", "epoch", "start_snapshot", "end_snapshot", "end_kind")


@query
def latest_epoch(spark, sf):
    found = ep.latest_epoch(ep.epochs(w.event_commits(spark, sf)))
    return found.select("table_id", "epoch", "start_snapshot")


@query
def assign_epoch(spark, sf):
    changes = w.table(spark, sf, "events").select(
        (F.col("event_id") + 1).alias("snapshot_id"), F.col("user_id").alias("table_id"),
        F.col("event_id").alias("rowid"))
    return ep.assign_epoch(changes, ep.epochs(w.event_commits(spark, sf))).select("table_id", "snapshot_id", "epoch")


@query
def at_boundary(spark, sf):
    return ep.at_boundary(ep.epochs(w.event_commits(spark, sf)))


@query
def live_epochs(spark, sf):
    return ep.live_epochs(ep.epochs(w.event_commits(spark, sf))).select("table_id", "epoch")


def _consumers(spark, sf):
    return ep.consumers(ep.epochs(w.event_commits(spark, sf)), "reader")


@query
def consumers(spark, sf):
    return _consumers(spark, sf).select("consumer", "table_id", "table", "status")


@query
def consumer_lookup(spark, sf):
    return ep.lookup(_consumers(spark, sf), "reader")


@query
def existing_names(spark, sf):
    return ep.existing_names(_consumers(spark, sf))


@query
def dropped_names(spark, sf):
    return ep.dropped_names(_consumers(spark, sf)).select("table_id", "dropped_name")


@query
def create_if_absent(spark, sf):
    """Readers still to be made: those of all epochs but the first, which exist."""
    known = ep.epochs(w.event_commits(spark, sf)).select("table_id", "start_snapshot", "epoch")
    return ep.create_if_absent(known, known.filter("epoch = 1"))


@query
def created_snapshot(spark, sf):
    return ep.created_snapshot(w.event_commits(spark, sf), "user_1", 100)


@query
def recreated(spark, sf):
    commits = w.event_commits(spark, sf)
    drops = commits.filter("op = 'drop'").select("table_id", "table", F.col("snapshot_id").alias("dropped_at"))
    return ep.recreated(drops, commits).select("table", "dropped_at", "created_snapshot")


# --- pairs and feed ---


@query
def pair_updates(spark, sf):
    price = lambda c: decode_row(c)["o_totalprice"].cast("double")
    found = pairs.pair_updates(w.orders_log(spark, sf))
    return found.select("table_id", "snapshot_id", "rowid", price("before").alias("price_before"), price("after").alias("price_after"))


@query
def pair_copies(spark, sf):
    """Halves in any order and with copies."""
    found = pairs.pair_updates(w.halves_log(w.table(spark, sf, "events")))
    return found.select("snapshot_id", "rowid", "before", "after", "first_seq", "last_seq")


@query
def typed_changes(spark, sf):
    status = lambda c: decode_row(c)["o_orderstatus"]
    log = w.orders_log(spark, sf).filter(F.col("table_id") == w.ORDERS_ID)
    return pairs.typed_changes(log).select(
        "type", "snapshot", "rowid", status("row").alias("status"), status("before").alias("status_before"))


@query
def diff_fields(spark, sf):
    updates = pairs.pair_updates(w.orders_log(spark, sf))
    found = changed_fields(updates, ["rowid"])
    number = F.col("field") == "o_totalprice"
    return found.select(
        "rowid", "field", F.when(~number, F.col("from_value")).alias("from_text"),
        F.when(~number, F.col("to_value")).alias("to_text"),
        F.when(number, F.col("from_value").cast("double")).alias("from_number"),
        F.when(number, F.col("to_value").cast("double")).alias("to_number"))


@query
def feed_top60(spark, sf):
    return pairs.feed(w.event_log(spark, sf)).select("seq", "kind", "table_id", "snapshot", "rowid")


@query
def feed_pairs(spark, sf):
    """Newest entries where updates have two halves: one entry at the place of the first."""
    log = w.orders_log(spark, sf, total_order=True).filter(F.col("table_id") == w.ORDERS_ID)
    status = lambda c: decode_row(c)["o_orderstatus"]
    return pairs.feed(log).select("kind", "rowid", status("before").alias("before"), status("after").alias("after"))


@query
def activity_feed(spark, sf):
    """Newest entries of one table, taken from the newest batches of the log on disk."""
    return newest_entries(_published(spark, sf), 3).select("seq", "kind", "snapshot", "rowid")


# --- metrics ---


@query
def lag_by_reader(spark, sf):
    log = w.event_log(spark, sf)
    heads = log.groupBy("table_id").agg(F.max("seq").alias("table_head"))
    readers = log.groupBy("table_id", "rowid").agg(F.min("seq").alias("last_seq"))
    head = log.agg(F.max("seq")).first()[0]
    return metrics.lag_by_reader(readers, heads, head).select(
        "table_id", "rowid", "last_seq", "waiting", "waiting_table",
        metrics.status(
            F.lit(None).cast("string"), F.col("waiting_table") == 0, F.col("waiting") < 5000).alias("state"))


@query
def latency_percentiles(spark, sf):
    """Time from a commit to its publication, where the next event of the user stands for the publication."""
    log = w.event_log(spark, sf)
    timed = look_along(log, ["rowid"], "seq", {"published_at": F.col("snapshot_time")}, ahead=True)
    return metrics.delivery_latency(timed.filter(F.col("published_at").isNotNull()), [0.5, 0.9, 0.99])


# --- lake and streams ---


@_once
def _lake(spark, sf) -> Lake:
    """History of orders: created, changed, a column dropped, one added and filled, it renamed, the
    table dropped and created again; customer joins in the second commit."""
    lake = Lake(spark, scratch_dir(spark, "lake"), buckets=8)
    orders = lake.create("orders", w.orders_v1(spark, sf), ["o_orderkey"])
    lake.commit([
        lake.replacing(orders, w.orders_v2(spark, sf)),
        lake.creation("customer", w.table(spark, sf, "customer"), ["c_custkey"]),
    ])
    lake.alter(orders, w.orders_v3(spark, sf).schema)
    v4 = w.orders_v4(spark, sf)
    lake.alter(orders, v4.schema)
    lake.replace(orders, v4)
    renamed = T.StructType([*w.orders_v3(spark, sf).schema.fields, T.StructField("p2", T.IntegerType())])
    lake.alter(orders, renamed, renames={"p2": "priority"})
    lake.drop(orders)
    lake.create("orders", w.orders_v3(spark, sf), ["o_orderkey"])
    return lake


@_once
def _captured(spark, sf) -> EventLog:
    log = EventLog(spark, scratch_dir(spark, "captured"))
    Capture(_lake(spark, sf), log).run_available(scratch_dir(spark, "checkpoint"), "earliest")
    return log


@query
def read_version(spark, sf):
    """The table as it was at its first snapshot."""
    return _lake(spark, sf).read_version(1, 1)


@query
def read_latest(spark, sf):
    """The table by name: the one created again, under its new id."""
    lake = _lake(spark, sf)
    return lake.read_version(lake.table_id("orders"))


@query
def snapshot_history(spark, sf):
    """The commits of the events after the hundredth, in order, with the tables they create."""
    found, _ = ep.history(w.event_commits(spark, sf), 100)
    return found.select("position", "snapshot_id", F.concat_ws(",", "created").alias("created"))


@query
def columns_at(spark, sf):
    """The columns each user's table had just before every commit to it."""
    commits = w.event_commits(spark, sf)
    asked = commits.select("table_id", (F.col("snapshot_id") - 1).alias("snapshot_id"))
    return ep.columns_at(commits, asked).select("table_id", "snapshot_id", F.concat_ws(",", "columns").alias("columns"),
                                                F.col("columns").isNull().alias("unknown"))


@query
def capture_stream(spark, sf):
    return _captured(spark, sf).read().select("message_id", "subject", "type", "table_id", "table", "snapshot_id", "change_type")


@query
def capture_order(spark, sf):
    """Sequences of the captured log: where each commit to each table begins and ends, without a
    gap or a repetition."""
    return _captured(spark, sf).read().groupBy("snapshot_id", "type", "table_id").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), _n().alias("events"),
        F.countDistinct("seq").alias("places"))


@query
def capture_rows(spark, sf):
    """Payloads of the captured events."""
    row = decode_row("row")
    return _captured(spark, sf).changes().select(
        "message_id", row["o_orderstatus"].alias("status"), row["o_totalprice"].cast("double").alias("price"),
        row["o_orderpriority"].alias("order_priority"), row["priority"].cast("int").alias("priority"),
        row["c_name"].alias("customer"))


@query
def captured_epochs(spark, sf):
    """Epochs of the lake, and how many captured changes lie in each."""
    found = ep.epochs(_lake(spark, sf).commits())
    changes = ep.assign_epoch(_captured(spark, sf).changes().select("table_id", "snapshot_id"), found)
    counted = changes.groupBy("table_id", "epoch").agg(_n().alias("changes"))
    return found.join(counted, ["table_id", "epoch"], "left").select(
        "table_id", "table", "epoch", "start_snapshot", "end_snapshot", "end_kind",
        F.concat_ws(",", "columns").alias("columns"), F.coalesce("changes", F.lit(0).cast("long")).alias("changes"))


@query
def follow_stream(spark, sf):
    reader = Follower(_captured(spark, sf), 1, ViewStore(spark, scratch_dir(spark, "view")))
    reader.run_available(scratch_dir(spark, "checkpoint"), start_after=0)
    row = F.col("row")
    return reader.rows().select(
        "rowid", row["o_orderstatus"].alias("status"), row["o_totalprice"].cast("double").alias("price"),
        row["priority"].cast("int").alias("priority"), F.map_contains_key("row", "o_orderpriority").alias("old_column"))


@query
def follow_status(spark, sf):
    """Status of a reader of customer after it followed the log."""
    reader = Follower(_captured(spark, sf), 2, ViewStore(spark, scratch_dir(spark, "view")))
    reader.run_available(scratch_dir(spark, "checkpoint"), start_after=0)
    return reader.status().select("status", "table", "channel", "received", "rows", "waiting_table", "needs_reload", "ended")


@query
def reload_view(spark, sf):
    """A view taken from the table itself at its second snapshot."""
    lake = _lake(spark, sf)
    reader = Follower(_captured(spark, sf), 1, ViewStore(spark, scratch_dir(spark, "view")))
    reader.reload(lake, 2)
    return view.typed_view(reader.rows(), w.orders_v2(spark, sf).schema).drop("rowid")


@query
def subscription(spark, sf):
    """Changes handed to a subscriber of orders, from the first event to the drop."""
    out = scratch_dir(spark, "handled")
    sub = Subscription(_captured(spark, sf), 1, scratch_dir(spark, "position"), start_after=0)
    status = lambda c: F.col(c)["o_orderstatus"]

    @sub.on_change
    def keep(changes):
        changes.select(
            "seq", "type", "snapshot", "rowid", status("row").alias("status"), status("before").alias("status_before")
        ).write.mode("append").parquet(out)

    sub.run_available(scratch_dir(spark, "checkpoint"))
    return spark.read.parquet(out).drop("seq")


@query
def ad_hoc_sql(spark, sf):
    """SQL over the lake and the log by the names of their tables."""
    register_views(spark, _lake(spark, sf), _captured(spark, sf))
    return run_sql(spark, """
        SELECT c.c_mktsegment AS segment, count(*) AS orders, count(DISTINCT o.o_custkey) AS customers
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment""")[0]


@query
def dedup_window(spark, sf):
    """Every event twice on a stream; the second copy falls into the window of the first."""
    schema = w.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    twice = stream.select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("time"),
        F.concat_ws("-", "user_id", "event_id").alias("message_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    out, checkpoint = scratch_dir(spark, "distinct"), scratch_dir(spark, "checkpoint")
    kept = sd.dedup_window(twice, "time").select("event_id", "user_id", "message_id")
    kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, user_id long, message_id string").parquet(out)


@query
def pair_stream(spark, sf):
    events = spark.readStream.schema(w.table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    path = scratch_dir(spark, "paired")
    sd.pair_stream(w.halves_log(events), path).trigger(availableNow=True).start().awaitTermination()
    return sd.read_pairs(spark, path).select("snapshot_id", "rowid", "before", "after", "first_seq", "last_seq")


@query
def pair_stream_copies(spark, sf):
    """All halves come again in a later batch of the stream: no update is given twice."""
    schema = w.table(spark, sf, "events").schema
    inbox, path = scratch_dir(spark, "inbox"), scratch_dir(spark, "paired")
    for part in (1, 2):
        w.table(spark, sf, "events").write.parquet(f"{inbox}/{part}")
        events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(inbox)
        sd.pair_stream(w.halves_log(events), path).trigger(availableNow=True).start().awaitTermination()
    return sd.read_pairs(spark, path).select("snapshot_id", "rowid", "before", "after", "first_seq", "last_seq")


@query
def pair_stream_batches(spark, sf):
    """Ten micro-batches in the order of the events; updates whose day is two days back are forgotten."""
    events, inbox, path = w.table(spark, sf, "events"), scratch_dir(spark, "inbox"), scratch_dir(spark, "paired")
    count = events.count()
    for tenth in range(10):
        events.filter(F.floor(F.col("event_id") * 10 / count) == tenth).coalesce(1).write.parquet(f"{inbox}/{tenth}")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(inbox)
    sd.pair_stream(w.halves_log(stream), path, wait="2 days").trigger(availableNow=True).start().awaitTermination()
    return sd.read_pairs(spark, path).select("snapshot_id", "rowid", "before", "after", "first_seq", "last_seq")


@query
def feed_negative_ids(spark, sf):
    """Row ids below zero, as half of all hashed ones are."""
    log = w.event_log(spark, sf).withColumn("rowid", F.col("rowid") - 1_000_000)
    return pairs.feed(log).select("seq", "kind", "table_id", "snapshot", "rowid")


@query
def log_seq_groups(spark, sf):
    """Numbers of a log of very many snapshots: each marker before the change of its snapshot."""
    events = w.event_log(spark, sf).drop("seq")
    markers = events.select(
        F.lit(SCHEMA_CHANGED).alias("type"), "table_id", "table", "snapshot_id", "snapshot_time")
    numbered, _ = assign_seq(union_log(events, markers))
    return numbered.select("seq", "type", "table_id", "snapshot_id")


@query
def follow_composite_key(spark, sf):
    """A table with a key of two columns, followed through a change of a third of its texts."""
    now = w.table(spark, sf, "conversations")
    lake = Lake(spark, scratch_dir(spark, "lake"), buckets=4)
    log = EventLog(spark, scratch_dir(spark, "log"))
    table = lake.create("conversations", now, ["conv_id", "turn"])
    lake.replace(table, now.withColumn("text", F.when(F.col("role") == "user", F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    Capture(lake, log).run_available(scratch_dir(spark, "checkpoint"), "earliest")
    reader = Follower(log, table, ViewStore(spark, scratch_dir(spark, "view"), buckets=4))
    reader.run_available(scratch_dir(spark, "checkpoint"), start_after=0)
    return view.typed_view(reader.rows(), now.schema).select("conv_id", "turn", "role", "text")


@query
def subscription_markers(spark, sf):
    """What the handlers of markers are called with, and how many changes came before."""
    sub = Subscription(_captured(spark, sf), 1, scratch_dir(spark, "position"), start_after=0)
    told, changes = [], [0]

    @sub.on_change
    def count(part):
        changes[0] += part.count()

    @sub.on_schema_change
    def reshaped(columns):
        told.append(("schema_changed", ",".join(columns), changes[0]))

    @sub.on_table_dropped
    def dropped():
        told.append(("table_dropped", None, changes[0]))

    sub.run_available(scratch_dir(spark, "checkpoint"))
    return local_table(spark, [(i, *t) for i, t in enumerate(told, 1)], "place long, kind string, columns string, changes long")


@query
def reader_restarts(spark, sf):
    """A reader started at the end, started over from the first event, stopped half-way and resumed: rows and
    position after each step."""
    log = _published(spark, sf)
    batches = log.batches().orderBy("ordinal").collect()
    view_path = scratch_dir(spark, "view")
    steps = []

    def step(name, reader):
        state = reader.store.load()
        steps.append((name, state["last_seq"], state["received"], reader.rows().count()))

    reader = Follower(log, 1, ViewStore(spark, view_path))
    reader.open()  # nothing saved: at the end
    step("at end", reader)
    reader = Follower(log, 1, ViewStore(spark, scratch_dir(spark, "view")))
    reader.open(0)
    reader.apply(batches[:2])
    step("half", reader)
    reader.disconnect()
    again = Follower(log, 1, reader.store)
    again.reconnect(scratch_dir(spark, "checkpoint")).awaitTermination()
    step("resumed", again)
    again.start_over()
    step("started over", again)
    return local_table(spark, steps, "step string, last_seq long, received long, rows long")


@query
def bootstrap_positions(spark, sf):
    """How many events captures find that start at a snapshot, at the beginning, and at the end before one more commit."""
    lake, found = _lake(spark, sf), []

    def step(name, log):
        seen = log.read().agg(_n().alias("n"), F.min("snapshot_id").alias("first")).first()
        found.append((name, seen["n"], seen["first"]))

    for start in (2, 5):
        log = EventLog(spark, scratch_dir(spark, "log"))
        Capture(lake, log).run_available(scratch_dir(spark, "checkpoint"), start)
        step(str(start), log)
    lake, log, checkpoint = Lake(spark, scratch_dir(spark, "lake")), EventLog(spark, scratch_dir(spark, "log")), scratch_dir(spark, "checkpoint")
    lake.create("nation", w.table(spark, sf, "nation"), ["n_nationkey"])
    Capture(lake, log).run_available(checkpoint, "latest")
    step("latest", log)
    lake.create("region", w.table(spark, sf, "region"), ["r_regionkey"])
    Capture(lake, log).run_available(checkpoint)
    step("later", log)
    return local_table(spark, found, "starting string, events long, first_snapshot long")


class _FailsOnce(EventLog):
    """Dies when the rows of a batch are written and its manifest is not."""

    def _put(self, manifest: dict) -> dict:
        if manifest["ordinal"] == 4:
            raise RuntimeError("the writer died")
        return super()._put(manifest)


@query
def capture_after_failure(spark, sf):
    """A capture that dies in its third batch, and another one that goes on without its checkpoint: every event once."""
    lake, path = _lake(spark, sf), scratch_dir(spark, "log")
    died = False
    try:
        Capture(lake, _FailsOnce(spark, path).create(), max_commits=2).publish_commits(lake.commits().collect())
    except RuntimeError:
        died = True
    log = EventLog(spark, path)
    Capture(lake, log).run_available(scratch_dir(spark, "checkpoint"), "earliest")
    return log.read().select("message_id", "type", "table_id", "snapshot_id", F.lit(died).alias("died"))


@query
def rebuilt_log(spark, sf):
    """The log made again from the history of the tables."""
    log = rebuild_log(_lake(spark, sf), scratch_dir(spark, "rebuilt"), scratch_dir(spark, "checkpoint"))
    return log.read().select("message_id", "type", "table_id", "snapshot_id")


@query
def reset_readers(spark, sf):
    """Readers whose positions lie before, within and past the end of the log."""
    events = w.table(spark, sf, "events")
    head = events.agg(F.max("event_id")).first()[0] + 1
    readers = events.groupBy("user_id").agg((F.max("event_id") + 1 + F.max("event_id") % 50 * 10).alias("last_seq"))
    return positions.position_status(readers, head // 2, head).withColumnRenamed("position_status", "state")


@query
def cleaned_history(spark, sf):
    """Which cursors a capture can go on from when the first three of the commits, one per region, are gone."""
    lake, regions = Lake(spark, scratch_dir(spark, "lake")), w.table(spark, sf, "region")
    keys = sorted(r[0] for r in regions.select("r_regionkey").collect())  # one per commit
    table = lake.create("region", regions.filter(F.col("r_regionkey") == keys[0]), ["r_regionkey"])
    for key in keys[1:]:
        lake.append(table, regions.filter(F.col("r_regionkey") == key))
    for number in (1, 2, 3):
        files.delete(files.manifest_path(lake.commits_path, number))
    found = []
    for cursor in range(len(keys)):
        capture = Capture(lake, EventLog(spark, scratch_dir(spark, "log")).create(cursor))
        try:
            found.append((cursor, "resume", capture.open()))
        except HistoryRemoved:
            found.append((cursor, "removed", None))
    return local_table(spark, found, "cursor long, state string, reads_after long")


@query
def capture_latency(spark, sf):
    """Times from commit to the moment the batch became visible, by the log's own clock: all are known, none is negative,
    and the percentiles ascend."""
    log = _captured(spark, sf)
    delivered = log.delivery()
    at = [r["value"] for r in metrics.delivery_latency(delivered.withColumn("type", F.lit(CHANGE)), [0.5, 0.9, 0.99]).orderBy("fraction").collect()]
    return delivered.groupBy("table_id").agg(
        _n().alias("events"), F.count_if(F.col("published_at") >= F.col("snapshot_time")).alias("not_early"),
    ).withColumn("ascending", F.lit(at == sorted(at) and at[0] > 0))


@query
def log_size(spark, sf):
    """Size of a log from its manifests, and what retention by rows leaves of it."""
    log = _published.__wrapped__(spark, sf)  # a log of its own, as it is changed here
    whole = log.size().select(F.lit("whole").alias("part"), "batches", "rows", (F.col("bytes") > 0).alias("has_bytes"))
    before = whole.collect()
    log.retain(max_rows=before[0]["rows"] // 2)
    kept = log.size().select(F.lit("kept").alias("part"), "batches", "rows", (F.col("bytes") > 0).alias("has_bytes"))
    return local_table(spark, [tuple(r) for r in before + kept.collect()], "part string, batches long, rows long, has_bytes boolean")


@query
def diff_nested(spark, sf):
    """Changes between two versions of rows with maps, structs and arrays of structs."""
    old, new = w.nested_versions(spark, sf)
    return diff_tables(old, new, ["conv_id"]).select("rowid", "change_type", F.col("row.by_role")["extra"].alias("extra"))


@query
def follow_typed(spark, sf):
    """A table with binary, map, struct, array and decimal columns, captured, followed and read with its types."""
    old, new = w.nested_versions(spark, sf)
    lake, log = Lake(spark, scratch_dir(spark, "lake")), EventLog(spark, scratch_dir(spark, "log"))
    table = lake.create("conversations", old, ["conv_id"])
    lake.replace(table, new)
    Capture(lake, log).run_available(scratch_dir(spark, "checkpoint"), "earliest")
    reader = Follower(log, table, ViewStore(spark, scratch_dir(spark, "view")))
    reader.run_available(scratch_dir(spark, "checkpoint"), start_after=0)
    rows = view.typed_view(reader.rows(), lake.state(table).schema)
    text = lambda array, part: F.array_join(F.transform(F.array_sort(array), part), ",")
    return rows.select(
        "conv_id", F.hex("payload").alias("payload"), F.hex("head.raw").alias("raw"), F.col("price").cast("double").alias("price"),
        text("turns", lambda t: F.concat_ws(":", t["turn"], t["role"])).alias("turns"),
        text(F.map_entries("by_role"), lambda e: F.concat_ws("=", e["key"], e["value"])).alias("by_role"))


@query
def follow_many_shapes(spark, sf):
    """A view of customer through two dozen changes of shape in five batches: columns come, go, and one comes back."""
    now = w.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    lake, log = Lake(spark, scratch_dir(spark, "lake")), EventLog(spark, scratch_dir(spark, "log")).create()
    capture = Capture(lake, log)
    table = lake.create("customer", now, ["c_custkey"])
    reader = Follower(log, table, ViewStore(spark, scratch_dir(spark, "view")))
    reader.open(0)
    fields, filled = list(now.schema.fields), {}
    for step in range(1, 25):
        name = "x5" if step == 21 else f"x{step}"
        if step % 2:
            fields.append(T.StructField(name, T.LongType()))
        elif step not in (4, 12, 20, 22):
            fields = [f for f in fields if f.name != f"x{step - 1}"]
        lake.alter(table, T.StructType(fields))
        if step in (3, 5, 11):  # a third of the rows each; x5 goes with its values and is empty when it is back
            filled = {c: v for c, v in filled.items() if c in [f.name for f in fields]} | {
                name: F.when(F.col("c_custkey") % 3 == step % 3, F.col("c_custkey") * step)}
            names = [f.name for f in fields]
            lake.replace(table, now.select(*[filled.get(c, F.col(c) if c in now.columns else F.lit(None)).cast("long").alias(c)
                                             if c.startswith("x") else F.col(c) for c in names]))
        if step in (4, 5, 11, 18, 24):
            done = log.newest()["end_snapshot"]
            capture.publish_commits(lake.commits().filter(F.col("snapshot_id") > done).collect())
            reader.apply([log.newest()])
    row = F.col("row")
    return reader.rows().select(
        "rowid", F.array_join(F.array_sort(F.map_keys("row")), ",").alias("columns"), row["c_name"].alias("name"),
        *[row[c].cast("long").alias(c) for c in ("x3", "x5", "x11", "x19")])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of orders compared, the changes ordered into a log, the log folded back."""
    return QUERIES["materialize_orders"](spark, sf)
