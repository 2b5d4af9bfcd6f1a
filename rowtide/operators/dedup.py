"""Events delivered more than once."""

from pyspark.sql import DataFrame, functions as F


def first_copies(events: DataFrame, by: str = "message_id", order: str = "seq") -> DataFrame:
    """Of every id keep the copy with the least ``order``.

    Copies are reduced before the shuffle, so an id that makes up a large share of the rows
    reaches its task as one row per input partition.
    """
    rest = [c for c in events.columns if c != by]
    kept = events.groupBy(by).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return kept.select(*[F.col(f"_row.`{c}`") if c != by else F.col(by) for c in events.columns])


def least_copies(events: DataFrame, by: str = "message_id") -> DataFrame:
    """Of every id keep the copy that is least by all other columns, in their order. A row is carried once, not beside
    itself as its order, as tasks sort what they reduce."""
    rest = [c for c in events.columns if c != by]
    kept = events.groupBy(by).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_row"))
    return kept.select(*[F.col(f"_row.`{c}`") if c != by else F.col(by) for c in events.columns])


def not_in_log(events: DataFrame, log: DataFrame, by: str = "message_id") -> DataFrame:
    """Events whose id the log does not hold yet. ``log`` should be cut to the batches that can
    hold them: see ``EventLog.publish``."""
    return events.join(log.select(by), by, "left_anti")
