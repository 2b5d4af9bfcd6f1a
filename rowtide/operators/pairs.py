"""Updates as one change: joining their two halves, typed changes, the activity feed."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowtide.functions.events import CHANGE, DELETE, INSERT, UPDATE_POST, UPDATE_PRE
from rowtide.operators.sequence import CELL_WIDTH
from rowtide.schemas import with_rowkey

PAIR = ["table_id", "snapshot_id", "rowid", "rowkey"]
FEED_LENGTH = 60  # fixed value: entries the feed shows


def halves(events: DataFrame) -> DataFrame:
    return events.filter((F.col("type") == CHANGE) & F.col("change_type").isin(UPDATE_PRE, UPDATE_POST))


def pair_updates(events: DataFrame, lone: bool = False) -> DataFrame:
    """The two halves of every update, in either order: ``table_id, snapshot_id, rowid, rowkey, before,
    after, first_seq, last_seq``.

    Copies of a half count once. Groups are reduced before the shuffle, so many copies of one half
    stay harmless, and rows are dealt by key and stretch of the log before that: reducing sorts them, which
    a task with a whole file of rows cannot do in memory. With ``lone`` updates that miss a half are given too.
    """
    pre, post = F.col("change_type") == UPDATE_PRE, F.col("change_type") == UPDATE_POST
    first_pre, first_post = F.min(F.when(pre, F.col("seq"))), F.min(F.when(post, F.col("seq")))
    dealt = with_rowkey(halves(events)).repartition(*PAIR, F.floor(F.col("seq") / CELL_WIDTH))
    paired = dealt.groupBy(*PAIR).agg(
        F.max(F.when(pre, F.col("row"))).alias("before"),
        F.max(F.when(post, F.col("row"))).alias("after"),
        F.least(first_pre, first_post).alias("first_seq"),
        F.greatest(first_pre, first_post).alias("last_seq"),
    )
    return paired if lone else paired.filter(F.col("before").isNotNull() & F.col("after").isNotNull())


def typed_changes(events: DataFrame) -> DataFrame:
    """Changes as subscribers see them: ``seq, table_id, type, snapshot, rowid, row, before``.

    An insert has no ``before``, a delete no ``row``. An update carries both and stands where its
    second half does. ``row`` and ``before`` stay JSON text; decode them where they are read.
    """
    single = events.filter((F.col("type") == CHANGE) & F.col("change_type").isin(INSERT, DELETE)).select(
        "seq", "table_id", F.col("change_type").alias("type"), F.col("snapshot_id").alias("snapshot"), "rowid",
        F.when(F.col("change_type") == INSERT, F.col("row")).alias("row"),
        F.when(F.col("change_type") == DELETE, F.col("row")).alias("before"),
    )
    updates = pair_updates(events).select(
        F.col("last_seq").alias("seq"), "table_id", F.lit("update").alias("type"),
        F.col("snapshot_id").alias("snapshot"), "rowid", F.col("after").alias("row"), "before",
    )
    return single.unionByName(updates)


_PLACE = ["kind", "table_id", "snapshot_id", "rowid", "rowkey"]
ENTRY = ("place long, kind string, table_id long, snapshot_id long, rowid long, rowkey string, before string, after string, "
         "time timestamp")


def _kind() -> Column:
    is_half = F.col("change_type").isin(UPDATE_PRE, UPDATE_POST)
    return F.when(F.col("type") != CHANGE, F.col("type")).when(is_half, "update").otherwise(F.col("change_type")).alias("kind")


def _with_payload(events: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """The chosen entries (their place among ``by``) with their rows; few enough to be broadcast."""
    named = [*by, *_PLACE]
    wanted = wanted.select(*[F.col(c).alias(f"_{c}") for c in named], "place")
    same = F.lit(True)
    for c in named:  # a marker has no row id
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    payload = events.select(*by, _kind(), *_PLACE[1:], "change_type", "row", "snapshot_time").join(F.broadcast(wanted), same)
    before, after = F.col("change_type").isin(UPDATE_PRE, DELETE), F.col("change_type").isin(UPDATE_POST, INSERT)
    return payload.groupBy(*named, "place").agg(
        F.max(F.when(before, F.col("row"))).alias("before"),
        F.max(F.when(after, F.col("row"))).alias("after"),
        F.min("snapshot_time").alias("time"))


def _shown(entries: DataFrame, *more: Column) -> DataFrame:
    return entries.select(
        F.col("place").alias("seq"), "kind", "table_id", F.col("snapshot_id").alias("snapshot"),
        "rowid", "before", "after", "time", *more,
    ).orderBy(F.desc("seq"))


def feed(events: DataFrame, length: int = FEED_LENGTH) -> DataFrame:
    """The newest entries, newest first: ``seq, kind, snapshot, rowid, before, after, time``.

    An update is one entry at the place of its first half. The entries are found on narrow columns;
    row payloads are read for the chosen ones only.
    """
    events = with_rowkey(events)
    slim = events.select("seq", _kind(), *_PLACE[1:])
    chosen = slim.groupBy(*_PLACE).agg(F.min("seq").alias("place")).orderBy(F.desc("place")).limit(length)
    return _shown(_with_payload(events, chosen, []))  # at most `length` rows


def newest_entries(events: DataFrame, length: int, by: str) -> DataFrame:
    """The newest entries (schema ``ENTRY``) of every value of ``by``, of which there must be few: what ``merged_feed``
    merges. The rank stops at ``length`` before the shuffle, so a value with most of the rows is no burden."""
    events = with_rowkey(events)
    slim = events.select(by, "seq", _kind(), *_PLACE[1:])
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("place")))
    chosen = slim.groupBy(by, *_PLACE).agg(F.min("seq").alias("place")).withColumn("rank", rank).filter(F.col("rank") <= length)
    return _with_payload(events, chosen.drop("rank"), [by]).select("place", *_PLACE, "before", "after", "time", by)


def merged_feed(entries: DataFrame, length: int = FEED_LENGTH) -> DataFrame:
    """The feed of a log from the newest entries of all its parts, as ``feed`` gives it. An update whose halves are in
    two parts is one entry again if both have it among their newest; else it shows without a half, and with ``whole``
    false."""
    merged = entries.groupBy(*_PLACE).agg(
        F.min("place").alias("place"), F.max("before").alias("before"), F.max("after").alias("after"), F.min("time").alias("time"))
    top = merged.orderBy(F.desc("place")).limit(length)
    whole = (F.col("kind") != "update") | (F.col("before").isNotNull() & F.col("after").isNotNull())
    return _shown(top, whole.alias("whole"))
