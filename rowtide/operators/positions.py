"""Where a reader stands in the log, and whether it can go on from there."""

from pyspark.sql import Column, DataFrame, functions as F


class PositionTooOld(Exception):
    """The saved position was removed from the log: reload the table."""


class LogWasReset(Exception):
    """The saved position is past the end of the log, or belongs to another log."""


def too_old(last_seq: Column, first_seq: Column) -> Column:
    """Are events after ``last_seq`` missing because retention removed them?"""
    return (first_seq > 0) & (last_seq + 1 < first_seq)


def was_reset(last_seq: Column, head: Column) -> Column:
    return last_seq > head


def check_position(last_seq: int, first_seq: int, head: int, saved_log: str | None = None, log: str | None = None):
    """One check for every kind of reader."""
    if saved_log is not None and log is not None and saved_log != log:
        raise LogWasReset(f"position {last_seq} belongs to log {saved_log}, this is {log}")
    if first_seq > 0 and last_seq + 1 < first_seq:
        raise PositionTooOld(f"events {last_seq + 1} to {first_seq - 1} were removed from the log before they were read")
    if last_seq > head:
        raise LogWasReset(f"the log ends at {head}, before position {last_seq}")


def position_status(readers: DataFrame, first_seq: int, head: int) -> DataFrame:
    """Add ``position_status`` to readers (``last_seq``): too_old, log_was_reset or resume; a
    reader without a position starts at the end."""
    status = (
        F.when(F.col("last_seq").isNull(), "start_at_end")
        .when(too_old(F.col("last_seq"), F.lit(first_seq)), "too_old")
        .when(was_reset(F.col("last_seq"), F.lit(head)), "log_was_reset")
        .otherwise("resume")
    )
    return readers.withColumn("position_status", status)


def log_bounds(batches: DataFrame) -> DataFrame:
    """First and last sequence, from the batch manifests: the log itself is not read."""
    held = batches.filter(F.col("rows") > 0)
    return held.agg(
        F.coalesce(F.min("first_seq"), F.lit(0)).alias("first_seq"),
        F.coalesce(F.max("last_seq"), F.lit(0)).alias("last_seq"),
    )
