"""Versions, commits and event logs derived from the given tables, by plain data rules.

``orders`` has a short history: what was placed before 2000, then everything still kept with urgent
open orders repriced, then columns dropped, added and renamed. ``events`` serves as a ready log and
as a ready commit history.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowtide.functions.events import (
    CHANGE, DELETE, INSERT, SCHEMA_CHANGED, TABLE_DROPPED, UPDATE_POST, UPDATE_PRE, change_events, message_id,
)
from rowtide.operators.diff import inserts, snapshot_diff, with_rowid
from rowtide.operators.sequence import assign_seq, union_log
from rowtide.schemas import EVENT, conform

ORDERS_ID, CUSTOMER_ID = 1, 2
PREFIX = "changes"
CUT = "2000-01-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- versions of orders ---


def orders_v1(spark: SparkSession, sf: str) -> DataFrame:
    """As the table was before 2000."""
    return table(spark, sf, "orders").filter(F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz"))


def orders_v2(spark: SparkSession, sf: str) -> DataFrame:
    """Later: finished orders of low priority are gone, urgent open ones cost 100 more and are
    in progress, and orders since 2000 have come in."""
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O")
    gone = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "F")
    orders = table(spark, sf, "orders").filter(~gone)
    return orders.select(
        "o_orderkey", "o_custkey", F.when(urgent, "P").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(urgent, F.col("o_totalprice") + 100).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate", "o_orderpriority",
    )


def orders_v3(spark: SparkSession, sf: str) -> DataFrame:
    return orders_v2(spark, sf).drop("o_orderpriority")


def orders_v4(spark: SparkSession, sf: str) -> DataFrame:
    """With a new column, set for large orders and NULL for the others."""
    return orders_v3(spark, sf).withColumn("priority", priority_of(F.col("o_totalprice")))


def priority_of(price: Column) -> Column:
    return F.when(price > 400_000, 1).when(price > 200_000, 2).cast("int")


def orders_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Changes from the first to the second version."""
    return snapshot_diff(
        with_rowid(orders_v1(spark, sf), ["o_orderkey"]), with_rowid(orders_v2(spark, sf), ["o_orderkey"])
    )


def orders_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Both commits of orders, and customer loaded in the second one, as events."""
    def commit(changes: DataFrame, table_id: int, name: str, snapshot: int) -> DataFrame:
        tagged = (
            changes.withColumn("table_id", F.lit(table_id).cast("long")).withColumn("table", F.lit(name))
            .withColumn("snapshot_id", F.lit(snapshot).cast("long"))
            .withColumn("snapshot_time", F.lit("2026-01-01 00:00:00").cast("timestamp"))
        )
        return change_events(tagged, PREFIX)

    first = commit(inserts(with_rowid(orders_v1(spark, sf), ["o_orderkey"])), ORDERS_ID, "orders", 1)
    second = commit(orders_diff(spark, sf), ORDERS_ID, "orders", 2)
    other = commit(inserts(with_rowid(table(spark, sf, "customer"), ["c_custkey"])), CUSTOMER_ID, "customer", 2)
    return first.unionByName(second).unionByName(other)


def orders_log(spark: SparkSession, sf: str, total_order: bool = False) -> DataFrame:
    """The events of ``orders_changes`` in log order."""
    events = union_log(orders_changes(spark, sf))
    return assign_seq(events, total_order=total_order)[0]


# --- events as a log ---

_KINDS = {"signup": INSERT, "view": UPDATE_PRE, "click": UPDATE_POST, "purchase": UPDATE_POST, "error": DELETE}


def kind_of(event_type: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    return kinds[event_type]


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """One change per row of ``events``: four tables, one row per user."""
    events = table(spark, sf, "events")
    return _enveloped(events.select(
        (F.col("event_id") + 1).alias("seq"), F.lit(CHANGE).alias("type"),
        F.pmod("user_id", F.lit(4)).cast("long").alias("table_id"),
        F.concat(F.lit("t"), F.pmod("user_id", F.lit(4)).cast("string")).alias("table"),
        (F.col("event_id") + 1).alias("snapshot_id"), F.col("user_id").alias("rowid"),
        kind_of(F.col("event_type")).alias("change_type"),
        F.to_json(F.struct("value", F.col("event_type").alias("kind"))).alias("row"),
        F.col("ts").cast("timestamp").alias("snapshot_time"),
    ))


def _enveloped(events: DataFrame) -> DataFrame:
    placed = conform(events.withColumn("subject", F.concat_ws(".", F.lit(PREFIX), F.col("table_id").cast("string"))), EVENT_WITH_SEQ)
    return placed.withColumn("message_id", message_id())


EVENT_WITH_SEQ = T.StructType([T.StructField("seq", T.LongType()), *EVENT.fields])


def is_drop() -> Column:
    return (F.col("event_type") == "error") & (F.col("value") >= 150)


def ending_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log in which tables are dropped: a costly error drops the table of its user."""
    events = table(spark, sf, "events")
    return events.select(
        (F.col("event_id") + 1).alias("seq"), F.col("user_id").alias("table_id"),
        F.when(is_drop(), TABLE_DROPPED).otherwise(CHANGE).alias("type"),
    )


def event_commits(spark: SparkSession, sf: str) -> DataFrame:
    """One commit per row of ``events``: every user a table, every kind of event a shape."""
    events = table(spark, sf, "events")
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    created = F.create_map(F.lit("tables_created"), F.array(name))
    nothing = F.create_map().cast("map<string,array<string>>")
    return events.select(
        (F.col("event_id") + 1).alias("snapshot_id"), F.col("user_id").alias("table_id"), name.alias("table"),
        F.when(is_drop(), "drop").otherwise("data").alias("op"), F.col("event_type").alias("schema_json"),
        F.array("event_type").alias("columns"),
        F.when(F.col("event_type") == "signup", created).otherwise(nothing).alias("changes"),
    )


def shape_columns() -> Column:
    """Columns a marker made of an event names; an error knows none."""
    names = F.array_compact(F.array(
        F.lit("id"), F.when(F.col("value") > 20, F.lit("amount")),
        F.when(F.col("event_type").isin("click", "purchase"), F.lit("priority")),
    ))
    return F.when(F.col("event_type") != "error", names)


def marker_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a schema marker of the table of its user."""
    events = table(spark, sf, "events")
    return events.select(
        F.col("user_id").alias("table_id"), (F.col("event_id") + 1).alias("seq"),
        F.lit(SCHEMA_CHANGED).alias("type"), shape_columns().alias("columns"),
    )


def mixed_log(spark: SparkSession, sf: str) -> DataFrame:
    """Views and sign-ups write rows (by whole value), all other events change the shape."""
    events = table(spark, sf, "events")
    writes = F.col("event_type").isin("view", "signup")
    row = F.to_json(F.struct(F.floor("value").alias("id"), F.col("event_id").alias("amount")))
    return _enveloped(events.select(
        (F.col("event_id") + 1).alias("seq"), F.when(writes, CHANGE).otherwise(SCHEMA_CHANGED).alias("type"),
        F.col("user_id").alias("table_id"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("table"),
        (F.col("event_id") + 1).alias("snapshot_id"),
        F.when(writes, F.floor("value")).alias("rowid"),
        F.when(writes, F.when(F.col("event_type") == "view", UPDATE_POST).otherwise(INSERT)).alias("change_type"),
        F.when(writes, row).alias("row"),
        F.when(~writes, shape_columns()).alias("columns"),
    ))


def halves_log(events: DataFrame) -> DataFrame:
    """Views are the first, clicks the second halves of updates of a user on a day; more than one
    of a kind on a day are copies."""
    views = F.col("event_type") == "view"
    return events.filter(F.col("event_type").isin("view", "click")).select(
        (F.col("event_id") + 1).alias("seq"), F.lit(1).cast("long").alias("table_id"),
        F.col("ts").cast("date").cast("timestamp").alias("snapshot_time"),
        F.unix_date(F.col("ts").cast("date")).cast("long").alias("snapshot_id"), F.col("user_id").alias("rowid"),
        F.lit(CHANGE).alias("type"), F.when(views, UPDATE_PRE).otherwise(UPDATE_POST).alias("change_type"),
        F.concat(F.col("event_type"), F.lit(" "), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("row"),
    )


def nested_versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as one nested row each, and again: maps with their entries the other way round, and one entry
    more in a third of them."""
    said = table(spark, sf, "conversations")
    roles = said.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    entries = roles.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("role", "n"))).alias("entries"))
    rows = said.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"), F.min_by("text", "turn").alias("text")).join(entries, "conv_id")

    def shaped(pairs):
        return rows.select(
            "conv_id", "turns", F.map_from_entries(pairs).alias("by_role"), F.encode(F.left("text", F.lit(40)), "UTF-8").alias("payload"),
            F.struct(F.lit("v").alias("kind"), F.encode(F.col("conv_id").cast("string"), "UTF-8").alias("raw")).alias("head"),
            (F.col("conv_id") / 8).cast("decimal(20,3)").alias("price"))

    more = F.when(F.col("conv_id") % 3 == 0, F.array(F.struct(F.lit("extra").alias("role"), F.col("conv_id").cast("long").alias("n"))))
    none = F.filter("entries", lambda _: F.lit(False))
    return shaped(F.col("entries")), shaped(F.reverse(F.concat("entries", F.coalesce(more, none))))
