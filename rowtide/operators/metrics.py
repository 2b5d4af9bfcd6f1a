"""Counts, lag, delivery latency, and the status record of a reader."""

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.functions.events import CHANGE
from rowtide.operators.sequence import number_rows
from rowtide.settings import local_table


def event_counts(events: DataFrame) -> DataFrame:
    """Events per table and kind."""
    kind = F.when(F.col("type") == CHANGE, F.col("change_type")).otherwise(F.col("type"))
    return events.groupBy("table_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("events"))


def batch_counts(events: DataFrame) -> DataFrame:
    """Events per published batch and its last snapshot."""
    return events.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("events"), F.max("snapshot_id").alias("end_snapshot")
    )


def waiting(head: Column, last_seq: Column) -> Column:
    """Events between a reader's position and the head; never negative."""
    return F.greatest(head - last_seq, F.lit(0))


def lag_by_reader(readers: DataFrame, heads: DataFrame, head: int) -> DataFrame:
    """Lag behind the whole log and behind the reader's own table.

    ``readers`` has ``table_id, last_seq``; ``heads`` has ``table_id, table_head``; ``head`` is the
    last sequence of the log. A reader of a quiet table may be far behind the head of the log and
    still have nothing to read, which only the second number shows."""
    joined = readers.join(heads, "table_id", "left").withColumn("head", F.lit(head).cast("long"))
    return joined.withColumn("waiting", waiting(F.col("head"), F.col("last_seq"))).withColumn(
        "waiting_table", waiting(F.coalesce("table_head", F.lit(0)), F.col("last_seq"))
    )


def status(error: Column, ended: Column, online: Column) -> Column:
    """error before ended before online before offline."""
    return (
        F.when(error.isNotNull(), "error").when(ended, "ended").when(online, "online").otherwise("offline")
    )


def exact_percentiles(df: DataFrame, value: str, fractions: list[float]) -> DataFrame:
    """Interpolated percentiles of a column: ``fraction, value``.

    Equal values are counted first, so a value that many rows share is one row from then on. The
    distinct values are sorted and ranked in parallel and only those at the wanted ranks are read:
    no task and not the driver holds them all."""
    spark = df.sparkSession
    counted = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    ranked, count = number_rows(counted, [value], "_last", weight="_n")
    if count == 0:
        return local_table(spark, [(f, None) for f in fractions], "fraction double, value double")
    wanted = []
    for fraction in fractions:
        low, share = divmod(fraction * (count - 1), 1)
        wanted += [(fraction, rank, share) for rank in {int(low) + 1, min(int(low) + 2, count)}]
    places = local_table(spark, wanted, "fraction double, _rank long, _share double")
    ranks = F.array(*[F.lit(r).cast("long") for r in sorted({r for _, r, _ in wanted})])
    hit = F.filter(ranks, lambda r: (r <= F.col("_last")) & (r > F.col("_last") - F.col("_n")))
    found = ranked.withColumn("_rank", F.explode(hit)).join(F.broadcast(places), "_rank")  # two rows per fraction
    ends = found.groupBy("fraction").agg(
        F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"),
        F.max("_share").alias("_share"),
    )
    return ends.select("fraction", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")).alias("value"))


def delivery_latency(log: DataFrame, fractions: list[float]) -> DataFrame:
    """Seconds from commit to publication, at the given fractions."""
    seconds = (
        F.unix_micros("published_at") - F.unix_micros("snapshot_time")
    ) / F.lit(1_000_000.0)
    changes = log.filter((F.col("type") == CHANGE) & F.col("snapshot_time").isNotNull())
    return exact_percentiles(changes.select(seconds.alias("seconds")), "seconds", fractions)


def reader_status(
    meta: DataFrame, received: DataFrame, names: DataFrame, view_rows: DataFrame, head: int,
    prefix: str, online: bool = False, error: str | None = None,
) -> DataFrame:
    """One record per table a reader follows."""
    rows = view_rows.groupBy("table_id").agg(F.count(F.lit(1)).alias("rows"))
    joined = (
        meta.join(received, "table_id", "left").join(names, "table_id", "left").join(rows, "table_id", "left")
        .withColumn("head", F.lit(head).cast("long"))
    )
    return joined.select(
        status(F.lit(error).cast("string"), F.col("ended"), F.lit(online)).alias("status"),
        F.lit(error).cast("string").alias("error"),
        "table_id", F.coalesce("table", F.lit("")).alias("table"),
        F.concat_ws(".", F.lit(prefix), F.col("table_id").cast("string")).alias("channel"),
        F.coalesce("received", F.lit(0)).cast("long").alias("received"),
        "last_seq", "head", waiting(F.col("head"), F.col("last_seq")).alias("waiting"),
        "needs_reload", "ended", "columns", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
    )
