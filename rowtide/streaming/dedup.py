"""Operators for event streams this package did not write."""

from pyspark.sql import DataFrame, functions as F

from rowtide.functions.events import CHANGE, UPDATE_POST, UPDATE_PRE
from rowtide.operators.pairs import PAIR, halves
from rowtide.schemas import with_rowkey
from rowtide.settings import local_table
from rowtide.sources import files

_HALF = "seq long, table_id long, snapshot_id long, rowid long, rowkey string, type string, change_type string, row string"
_PAIR = (
    "table_id long, snapshot_id long, rowid long, rowkey string, before string, after string, first_seq long, last_seq long"
)
_STATE = (
    "struct<before: string, after: string, seq_pre: long, seq_post: long, batch_pre: timestamp, batch_post: timestamp, "
    "batch_now: timestamp>"
)
DUPLICATE_WINDOW = "2 minutes"  # fixed value: how long ids are remembered by default


def dedup_window(stream: DataFrame, time: str, window: str = DUPLICATE_WINDOW) -> DataFrame:
    """Drop events whose id came within the window before.

    Rows older than the watermark are dropped too, also new ones: use it only on a stream in time
    order. The log itself never forgets an id (``EventLog.publish``).
    """
    return stream.withWatermark(time, window).dropDuplicatesWithinWatermark(["message_id"])


def pair_stream(stream: DataFrame, path: str, wait: str | None = None, time: str = "snapshot_time"):
    """Writer that pairs the halves of updates over all batches of a stream.

    Both halves of an update meet in Spark's state store, so a batch costs what its own updates cost, however many
    came before. The batch in which an update becomes complete writes it, once, to ``<path>/pairs/batch=<n>``; a
    repeated batch writes the same folder again, and copies that come later change nothing. With ``wait`` an
    update is forgotten when the stream's time (the column ``time``, one value per snapshot) is that much further: a half
    that comes later still is dropped, as is a copy. Without it halves wait for ever. The checkpoint lies beside the pairs.
    """
    files.make_dir(f"{path}/pairs")
    pre, post = F.col("change_type") == UPDATE_PRE, F.col("change_type") == UPDATE_POST
    rows, by = with_rowkey(halves(stream)), list(PAIR)
    if wait is not None:
        rows, by = rows.withWatermark(time, wait), [*PAIR, time]
    # The time of a micro-batch is one value, and the same when the batch is repeated.
    rows = rows.withColumn("_batch", F.current_timestamp())
    states = rows.groupBy(*by).agg(
        F.max(F.when(pre, F.col("row"))).alias("before"), F.max(F.when(post, F.col("row"))).alias("after"),
        F.min(F.when(pre, F.col("seq"))).alias("seq_pre"), F.min(F.when(post, F.col("seq"))).alias("seq_post"),
        F.min(F.when(pre, F.col("_batch"))).alias("batch_pre"), F.min(F.when(post, F.col("_batch"))).alias("batch_post"),
        F.max("_batch").alias("batch_now"))

    def on_batch(batch: DataFrame, number: int) -> None:
        complete = F.col("batch_pre").isNotNull() & F.col("batch_post").isNotNull()
        now = batch.filter(complete & (F.greatest("batch_pre", "batch_post") == F.col("batch_now")))
        now.select(
            *PAIR, "before", "after", F.least("seq_pre", "seq_post").alias("first_seq"), F.greatest("seq_pre", "seq_post").alias("last_seq"),
        ).write.mode("overwrite").parquet(f"{path}/pairs/batch={number}")

    return states.writeStream.outputMode("update").foreachBatch(on_batch).option("checkpointLocation", f"{path}/checkpoint")


def read_pairs(spark, path: str) -> DataFrame:
    return spark.read.schema(f"{_PAIR}, batch int").parquet(f"{path}/pairs").select(*PAIR, "before", "after", "first_seq", "last_seq")


def lone_halves(spark, path: str) -> DataFrame:
    """Halves still waiting for their partner, read from the state of the stopped stream."""
    if not files.exists(f"{path}/checkpoint/state"):
        return local_table(spark, [], _HALF)
    kept = spark.read.format("statestore").load(f"{path}/checkpoint").select(
        "key.*", F.col("value").cast(_STATE).alias("s"))  # the names in the state are those of Spark's buffers
    seq = F.coalesce("s.seq_pre", "s.seq_post")
    return kept.filter(F.col("s.batch_pre").isNull() | F.col("s.batch_post").isNull()).select(
        seq.alias("seq"), *PAIR, F.lit(CHANGE).alias("type"),
        F.when(F.col("s.batch_pre").isNotNull(), UPDATE_PRE).otherwise(UPDATE_POST).alias("change_type"),
        F.coalesce("s.before", "s.after").alias("row"))
