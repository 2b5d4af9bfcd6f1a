"""Epochs: the stretches of a table's history with one shape."""

from pyspark.sql import DataFrame, functions as F

from rowtide.functions.events import SCHEMA_CHANGED, TABLE_DROPPED
from rowtide.functions.rows import contains
from rowtide.operators.sequence import look_along, number_rows, running_count
from rowtide.settings import written


def epochs(commits: DataFrame) -> DataFrame:
    """One row per epoch of every table id.

    An epoch begins where a table is first seen or its shape (``schema_json``) differs from the one
    before. It ends where the next begins, or for good where the table is dropped. A rename changes
    neither id nor shape, so it ends nothing. Commits after the drop of an id are ignored.
    """
    touched = commits.filter(F.col("table_id").isNotNull())
    seen = look_along(
        touched, ["table_id"], "snapshot_id",
        {
            "_shape": F.when(F.col("op") != "drop", F.coalesce("schema_json", F.lit(""))),
            "_gone": F.when(F.col("op") == "drop", F.col("snapshot_id")),
            "_name": F.col("table"),
        },
    ).filter(F.col("_gone").isNull())
    shape = F.coalesce("schema_json", F.lit(""))
    begins = (F.col("op") != "drop") & ~shape.eqNullSafe(F.col("_shape"))
    # Commits that change neither shape nor name, nearly all of them, are done with here.
    turning = begins | (F.col("op") == "drop") | ~F.col("table").eqNullSafe(F.col("_name"))
    kept = ["table_id", "snapshot_id", "op", "table", "columns", "schema_json"]
    points = written(seen.filter(turning).select(*kept, begins.alias("_begins")), "turning-points")
    numbered = running_count(points, ["table_id"], "snapshot_id", F.col("_begins"), "epoch")
    grouped = numbered.filter(F.col("epoch") > 0).groupBy("table_id", "epoch").agg(
        F.min("snapshot_id").alias("start_snapshot"),
        F.min(F.when(F.col("op") == "drop", F.col("snapshot_id"))).alias("_dropped_at"),
        F.min_by("table", "snapshot_id").alias("original_table"),
        F.max_by("table", F.when(F.col("table").isNotNull(), F.col("snapshot_id"))).alias("table"),
        F.min_by("columns", "snapshot_id").alias("columns"),
        F.min_by("schema_json", "snapshot_id").alias("schema_json"),
    )
    ended = look_along(
        grouped, ["table_id"], "epoch", {"_next": F.col("start_snapshot")}, ahead=True
    )
    return ended.select(
        "table_id", "table", "original_table", F.col("epoch").cast("int").alias("epoch"), "start_snapshot",
        F.coalesce("_dropped_at", "_next").alias("end_snapshot"),
        F.when(F.col("_dropped_at").isNotNull(), TABLE_DROPPED)
        .when(F.col("_next").isNotNull(), SCHEMA_CHANGED).alias("end_kind"),
        "columns", "schema_json",
    )


def markers_of(epochs_df: DataFrame) -> DataFrame:
    """The marker that closes each ended epoch: ``type, table_id, table, snapshot_id, columns``.
    The columns are those of the epoch that follows."""
    follower = look_along(
        epochs_df, ["table_id"], "epoch", {"_next_columns": F.col("columns")}, ahead=True
    )
    return follower.filter(F.col("end_kind").isNotNull()).select(
        F.col("end_kind").alias("type"), "table_id", "table", F.col("end_snapshot").alias("snapshot_id"),
        F.when(F.col("end_kind") == SCHEMA_CHANGED, F.col("_next_columns")).alias("columns"),
    )


def assign_epoch(changes: DataFrame, epochs_df: DataFrame) -> DataFrame:
    """Add ``epoch`` to every change: ``start_snapshot <= snapshot_id < end_snapshot``.

    The snapshots that changed a table and the starts of its epochs are put in one order, and the last
    epoch is carried forward along it, so a change meets its own epoch only, however many the table
    has. A row that no epoch covers gets NULL.
    """
    starts = epochs_df.filter(
        F.col("end_snapshot").isNull() | (F.col("end_snapshot") > F.col("start_snapshot"))
    ).select(
        "table_id", (F.col("start_snapshot") * 2).alias("_place"), F.struct("epoch", "end_snapshot").alias("_epoch")
    )
    places = changes.select("table_id", "snapshot_id").distinct().filter("table_id IS NOT NULL AND snapshot_id IS NOT NULL")
    line = places.select("table_id", (F.col("snapshot_id") * 2 + 1).alias("_place"), "snapshot_id").unionByName(
        starts, allowMissingColumns=True)
    seen = look_along(line, ["table_id"], "_place", {"_last": F.col("_epoch")}).filter(F.col("snapshot_id").isNotNull())
    covers = F.col("_last.end_snapshot").isNull() | (F.col("snapshot_id") < F.col("_last.end_snapshot"))
    known = seen.select("table_id", "snapshot_id", F.when(covers, F.col("_last.epoch")).alias("epoch"))
    return changes.join(known, ["table_id", "snapshot_id"], "left")


def columns_at(commits: DataFrame, asked: DataFrame) -> DataFrame:
    """Column names (``columns``) of the tables and snapshots asked for (``table_id, snapshot_id``): those of the
    last commit up to the snapshot, NULL where the table is not there yet or was dropped."""
    line = asked.select("table_id", (F.col("snapshot_id") * 2 + 1).alias("_place"), "snapshot_id").distinct()
    known = commits.filter(F.col("table_id").isNotNull()).select(
        "table_id", (F.col("snapshot_id") * 2).alias("_place"), "op", F.col("columns").alias("_columns"))
    seen = look_along(
        line.unionByName(known, allowMissingColumns=True), ["table_id"], "_place",
        {"_shape": F.when(F.col("op") != "drop", F.col("_columns")), "_gone": F.when(F.col("op") == "drop", F.lit(True))},
    ).filter(F.col("snapshot_id").isNotNull())
    return seen.select("table_id", "snapshot_id", F.when(F.col("_gone").isNull(), F.col("_shape")).alias("columns"))


def history(commits: DataFrame, after: int) -> tuple[DataFrame, int]:
    """Snapshots after one in ascending order: ``position`` (from 1), ``snapshot_id`` and the names ``created``;
    and how many there are."""
    names = F.coalesce(F.col("changes")["tables_created"], F.array().cast("array<string>"))
    later = commits.filter(F.col("snapshot_id") > after).groupBy("snapshot_id").agg(
        F.array_distinct(F.flatten(F.collect_list(names))).alias("created"))  # one entry per table a commit creates
    return number_rows(later, ["snapshot_id"], "position")


def latest_epoch(epochs_df: DataFrame) -> DataFrame:
    """The newest epoch of every table id: where its reader is."""
    newest = F.max_by(F.struct("epoch", "start_snapshot", "end_snapshot", "table"), F.col("start_snapshot"))
    return epochs_df.groupBy("table_id").agg(newest.alias("e")).select("table_id", "e.*")


def live_epochs(epochs_df: DataFrame) -> DataFrame:
    """Epochs of tables that still exist and are not at a boundary."""
    return epochs_df.filter(F.col("table_id").isNotNull() & F.col("end_snapshot").isNull())


def at_boundary(epochs_df: DataFrame) -> DataFrame:
    """``terminal`` and, if so, the snapshot the epoch ended at."""
    return epochs_df.select(
        "table_id", "epoch", F.col("end_snapshot").isNotNull().alias("terminal"),
        F.col("end_snapshot").alias("terminal_at_snapshot"),
    )


def consumers(epochs_df: DataFrame, base: str) -> DataFrame:
    """Readers, one per epoch: the first has the base name, a successor ``<base>_<boundary>``."""
    name = F.when(F.col("epoch") == 1, F.lit(base)).otherwise(
        F.concat_ws("_", F.lit(base), F.col("start_snapshot").cast("string"))
    )
    status = F.when(F.col("end_kind") == TABLE_DROPPED, "dropped").when(
        F.col("end_kind") == SCHEMA_CHANGED, "ended").otherwise("active")
    return epochs_df.select(
        name.alias("consumer"), "table_id", "table", "start_snapshot", status.alias("status"),
        F.col("table").alias("current_name"), F.col("original_table").alias("original_name"),
    )


def dropped_names(consumers_df: DataFrame) -> DataFrame:
    """Name of the table of every reader whose table was dropped: the current one, else the first."""
    return consumers_df.filter(F.col("status") == "dropped").select(
        "consumer", "table_id", F.coalesce("current_name", "original_name").alias("dropped_name")
    )


def lookup(consumers_df: DataFrame, consumer: str) -> DataFrame:
    """Table id and name of one reader."""
    return consumers_df.filter(F.col("consumer") == consumer).select("table_id", "table")


def existing_names(consumers_df: DataFrame) -> DataFrame:
    return consumers_df.select("consumer").distinct()


def create_if_absent(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose ``(table_id, start_snapshot)`` has no reader yet: safe to repeat."""
    return candidates.join(existing, ["table_id", "start_snapshot"], "left_anti")


def created_snapshot(commits: DataFrame, name: str, after: int) -> DataFrame:
    """First snapshot after ``after`` that created a table called ``name``; NULL if none did."""
    created = (F.col("snapshot_id") > after) & contains("changes", "tables_created", F.lit(name))
    return commits.filter(created).agg(F.min("snapshot_id").alias("created_snapshot"))


def recreated(drops: DataFrame, commits: DataFrame) -> DataFrame:
    """For every dropped name (``table_id, table, dropped_at``) the first snapshot after the drop
    that created the name again, NULL while it has not happened."""
    names = F.coalesce(F.col("changes")["tables_created"], F.array().cast("array<string>"))
    created = commits.select("snapshot_id", F.explode(names).alias("table"))
    both = drops.select("table", F.col("dropped_at").alias("snapshot_id"), F.lit(None).cast("long").alias("_created"), F.col("table_id").alias("_owner"))
    line = both.unionByName(
        created.select("table", "snapshot_id", F.col("snapshot_id").alias("_created"), F.lit(None).cast("long").alias("_owner"))
    ).groupBy("table", "snapshot_id").agg(F.max("_created").alias("_created"), F.max("_owner").alias("_owner"))
    found = look_along(line, ["table"], "snapshot_id", {"created_snapshot": F.col("_created")}, ahead=True)
    return found.filter(F.col("_owner").isNotNull()).select(
        F.col("_owner").alias("table_id"), "table", F.col("snapshot_id").alias("dropped_at"), "created_snapshot"
    )
