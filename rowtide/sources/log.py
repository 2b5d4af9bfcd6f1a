"""The event log: an ordered, replayable Parquet table with one manifest per published batch.

    <log>/batches/<ordinal>.json                      manifest: sequence and snapshot range, folder
    <log>/events/batch=<token>/table_id=<t>/*.parquet events
    <log>/markers/batch=<token>/table_id=<t>/*.parquet the markers among them once more, for batches that have any

A range of the log is read as a join with its manifests on the batch: Spark prunes the folders of all other batches
at run time, and no list of paths passes through the driver. Whoever needs markers only reads the side table.

A batch exists from the moment its manifest does. An attempt that dies earlier leaves a folder no
manifest names, which no reader looks at. The newest manifest is the cursor of the capture: commits
up to its ``end_snapshot`` are in the log.
"""

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowtide.functions.events import CHANGE, describe
from rowtide.operators.dedup import least_copies, not_in_log
from rowtide.operators.positions import log_bounds
from rowtide.operators.sequence import assign_seq, union_log
from rowtide.operators.view import drop_points, stop_at_drop
from rowtide.schemas import BATCHES, EVENT, LOG, conform
from rowtide.settings import check_path, local_table
from rowtide.sources import files
from rowtide.sources.idfilter import IdFilters

_STORED = T.StructType(LOG.fields + [T.StructField("batch", T.StringType())])


class EventLog:
    """``rows_in_order`` makes the writer sort each commit to a table by row id too, at the price of
    a range shuffle; otherwise the rows of a commit are numbered as they come."""

    def __init__(self, spark: SparkSession, path: str, prefix: str = "changes", rows_in_order: bool = False):
        self.spark, self.path, self.prefix = spark, check_path(spark, path), prefix
        self.rows_in_order = rows_in_order

    @property
    def batches_path(self) -> str:
        return f"{self.path}/batches"

    @property
    def events_path(self) -> str:
        return f"{self.path}/events"

    @property
    def markers_path(self) -> str:
        return f"{self.path}/markers"

    # --- the list of batches ---

    def create(self, start_snapshot: int = 0) -> "EventLog":
        """Make the log if it is not there; a new one begins after ``start_snapshot``."""
        files.make_dir(self.batches_path)
        files.make_dir(self.events_path)
        files.make_dir(self.markers_path)
        if not files.manifest_numbers(self.batches_path):
            self._put({
                "ordinal": 1, "batch_id": start_snapshot, "path": None, "start_snapshot": start_snapshot,
                "end_snapshot": start_snapshot, "first_seq": 1, "last_seq": 0, "rows": 0,
                "marked": False, "tables": [], "log_id": uuid.uuid4().hex,
            })
        return self

    def _put(self, manifest: dict) -> dict:
        """Make a batch visible. Its time of publication is taken here, when its rows are in place."""
        size = files.folder_bytes(f"{self.events_path}/{manifest['path']}") if manifest["path"] else 0
        manifest = {**manifest, "bytes": size, "published_at": dt.datetime.now(dt.timezone.utc)}
        files.write_json(files.manifest_path(self.batches_path, manifest["ordinal"]), [manifest], new=True)
        return manifest

    def exists(self) -> bool:
        return bool(files.manifest_numbers(self.batches_path))

    def batches(self) -> DataFrame:
        return self.spark.read.schema(BATCHES).json(self.batches_path)

    def newest(self) -> dict:
        numbers = files.manifest_numbers(self.batches_path)
        return files.read_json(files.manifest_path(self.batches_path, numbers[-1]))[0]

    def bounds(self) -> DataFrame:
        return log_bounds(self.batches())

    def first_seq(self) -> int:
        """First sequence still held, or the next one of an empty log."""
        numbers = files.manifest_numbers(self.batches_path)
        return files.read_json(files.manifest_path(self.batches_path, numbers[0]))[0]["first_seq"]

    def head(self) -> int:
        return self.newest()["last_seq"]

    # --- writing ---

    def publish(
        self, events: DataFrame, start_snapshot: int | None = None, end_snapshot: int | None = None,
        distinct: bool = False, marked: bool | None = None,
    ) -> dict:
        """Append one batch of events (schema ``EVENT``) in log order; give its manifest.

        Ids already in the log are not stored again, so a repeated publish changes nothing. The log
        is searched only in batches whose snapshots reach those of the new events and whose id filter may hold
        one of their ids. ``distinct`` says
        the caller knows the ids to be new, as the capture does, and skips that search; ``marked`` says
        whether there are markers among them, where the caller knows.
        """
        last = self.newest()
        if not distinct:
            low = events.agg(F.min("snapshot_id").alias("s")).first()["s"]
            events = least_copies(events)  # copies of an id may differ in what they carry
            if low is not None:
                events = not_in_log(events, self._holding(events, low))
        token = f"{last['ordinal'] + 1:012d}-{uuid.uuid4().hex}"
        stage = f"{self.path}/staging/{token}"
        try:
            ordered = union_log(conform(events, EVENT))
            numbered, rows = assign_seq(ordered, last["last_seq"], stage, self.rows_in_order)
            if end_snapshot is None:
                top = numbered.agg(F.max("snapshot_id").alias("s")).first()["s"]
                end_snapshot = max(last["end_snapshot"], top) if top is not None else last["end_snapshot"]
            published = dt.datetime.now(dt.timezone.utc)
            path = None
            if rows:
                path = f"batch={token}"
                numbered.withColumn("published_at", F.lit(published)).withColumn(
                    "batch_id", F.lit(end_snapshot).cast("long")
                ).select(LOG.fieldNames()).write.mode("overwrite").partitionBy("table_id").parquet(
                    f"{self.events_path}/{path}"
                )
                marked = self._keep_markers(path, marked)
        finally:
            files.delete(stage)
        if start_snapshot is None:
            start_snapshot = end_snapshot
        return self._put({
            "ordinal": last["ordinal"] + 1, "batch_id": end_snapshot, "path": path,
            "start_snapshot": start_snapshot, "end_snapshot": end_snapshot, "first_seq": last["last_seq"] + 1,
            "last_seq": last["last_seq"] + rows, "rows": rows, "marked": bool(marked and path),
            "tables": self._tables_in(path), "log_id": last["log_id"],
        })

    def _holding(self, events: DataFrame, min_snapshot: int) -> DataFrame:
        """``batch, message_id`` of the batches that may hold an id of the events."""
        named = F.regexp_replace("path", "^batch=", "").alias("batch")
        batches = self.batches().filter((F.col("rows") > 0) & (F.col("end_snapshot") >= F.lit(min_snapshot))).select(named, "rows")
        stored = self.spark.read.schema(_STORED).option("basePath", self.events_path).parquet(self.events_path).select("batch", "message_id")
        filters = IdFilters(self.spark, f"{self.path}/ids")
        filters.build(batches, stored)
        found = filters.holding(events.select("message_id"), batches)
        # What is found is a small table on disk, so it is broadcast, and the comparison makes it a filter that prunes folders.
        return stored.join(found.filter(F.length("batch") > 0), "batch")

    def _keep_markers(self, path: str, marked: bool | None) -> bool:
        """Write the markers of a batch that is in place to the side table, if it has any."""
        found = self.read_paths([path]).filter(F.col("type") != CHANGE)
        if marked is None:
            marked = not found.isEmpty()
        if marked:  # one per commit of the batch at most
            found.repartition(1).write.mode("overwrite").partitionBy("table_id").parquet(f"{self.markers_path}/{path}")
        return marked

    def _tables_in(self, path: str | None) -> list[int]:
        names = files.subfolders(f"{self.events_path}/{path}") if path else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("table_id=") and n.split("=")[1].isdigit())

    # --- reading ---

    def read(
        self, table_id: int | None = None, after: int | None = None, upto: int | None = None,
        min_snapshot: int | None = None,
    ) -> DataFrame:
        """Events after a position, of one table if given. Batches outside the range, or without the table, are not
        opened: their folders are pruned by the join with the manifests. Not for a range that ``retain`` may remove
        while it is read."""
        return self._in_range(self.events_path, F.col("rows") > 0, table_id, after, upto, min_snapshot)

    def markers(
        self, table_id: int | None = None, after: int | None = None, upto: int | None = None,
        min_snapshot: int | None = None,
    ) -> DataFrame:
        """Markers of the same range, from the side table: no file with changes is opened."""
        return self._in_range(self.markers_path, F.col("marked"), table_id, after, upto, min_snapshot)

    def live(self, table_id: int | None = None, after: int | None = None) -> DataFrame:
        """Events after a position without those that follow a drop of their table. The drops come from the side
        table, so the events are read once."""
        return stop_at_drop(self.read(table_id, after), drop_points(self.markers(table_id)))

    def _in_range(self, path: str, held: Column, table_id, after, upto, min_snapshot) -> DataFrame:
        for value, test in (
            (after, F.col("last_seq") > F.lit(after)), (upto, F.col("first_seq") <= F.lit(upto)),
            (min_snapshot, F.col("end_snapshot") >= F.lit(min_snapshot)),
            (table_id, F.array_contains("tables", F.lit(table_id).cast("long"))),
        ):
            if value is not None:
                held = held & test
        # The manifests are listed first: what they name is in place when the folders are listed.
        batches = self.batches().filter(held).select(F.regexp_replace("path", "^batch=", "").alias("batch"))
        stored = self.spark.read.schema(_STORED).option("basePath", path).parquet(path)
        return _within(stored.join(batches, "batch").select(LOG.fieldNames()), table_id, after, upto, min_snapshot)

    def markers_in(self, batches: list, table_id: int) -> DataFrame:
        """Markers of one table in published batches."""
        paths = [f"{self.markers_path}/{b['path']}" for b in batches if b["marked"]]
        if not paths:
            return local_table(self.spark, [], LOG)
        found = self.spark.read.schema(_STORED).option("basePath", self.markers_path).parquet(*paths)
        return _within(found.select(LOG.fieldNames()), table_id)

    def newest_batches(self, table_id: int, after: int, most: int) -> list:
        """Manifests of the newest batches with events of a table after a position, newest first."""
        held = self.batches().filter(
            (F.col("rows") > 0) & (F.col("last_seq") > F.lit(after)) & F.array_contains("tables", F.lit(table_id).cast("long")))
        return held.select("ordinal", "path", "first_seq", "last_seq").orderBy(F.desc("ordinal")).limit(most).collect()

    def in_batches(self, tokens: list[str], table_id: int, after: int | None = None) -> DataFrame:
        """Events of one table in some batches, with a column ``batch``."""
        if not tokens:
            return local_table(self.spark, [], _STORED)
        found = self.spark.read.schema(_STORED).option("basePath", self.events_path).parquet(
            *[f"{self.events_path}/batch={t}/table_id={table_id}" for t in tokens])
        return _within(found, table_id, after)

    def read_paths(
        self, paths: list[str], table_id: int | None = None, after: int | None = None, upto: int | None = None,
        min_snapshot: int | None = None,
    ) -> DataFrame:
        if not paths:
            return local_table(self.spark, [], LOG)
        found = self.spark.read.schema(_STORED).option("basePath", self.events_path).parquet(
            *[f"{self.events_path}/{p}" for p in paths])
        return _within(found.select(LOG.fieldNames()), table_id, after, upto, min_snapshot)

    def delivery(self, after: int | None = None) -> DataFrame:
        """``seq, table_id, snapshot_time, published_at`` of the changes, with the time their batch became
        visible: rows carry the time they were written, which is earlier."""
        rows = self.spark.read.schema(_STORED).option("basePath", self.events_path).parquet(self.events_path)
        rows = rows.filter((F.col("type") == CHANGE) & (F.col("seq") > F.lit(after or 0)))
        times = self.batches().filter("rows > 0").select(
            F.regexp_replace("path", "^batch=", "").alias("batch"), F.col("published_at").alias("visible_at"))
        return rows.join(times, "batch").select(
            "seq", "table_id", "snapshot_time", F.col("visible_at").alias("published_at"))

    def dump(self) -> DataFrame:
        """Every event held, readable, in order."""
        return describe(self.read()).orderBy("seq")

    # --- keeping it in bounds ---

    def retain(
        self, max_age: dt.timedelta | None = None, max_rows: int | None = None, max_batches: int | None = None,
        from_seq: int | None = None, now: dt.datetime | None = None, max_bytes: int | None = None,
    ) -> int:
        """Remove the oldest batches beyond a limit; the newest manifest always stays, it is the
        cursor. Gives the number of batches removed."""
        now = now or dt.datetime.now(dt.timezone.utc)
        numbers, held = files.manifest_numbers(self.batches_path), self.size().first()
        removed, kept_rows, kept_bytes = 0, held["rows"], held["bytes"]
        for position, number in enumerate(numbers[:-1]):  # the oldest first, and no more than are due
            row = files.read_json(files.manifest_path(self.batches_path, number))[0]
            beyond = (
                (max_age is not None and now - dt.datetime.fromisoformat(row["published_at"]) > max_age)
                or (max_rows is not None and kept_rows > max_rows)
                or (max_bytes is not None and kept_bytes > max_bytes)
                or (max_batches is not None and len(numbers) - position > max_batches)
                or (from_seq is not None and row["last_seq"] < from_seq)
            )
            if not beyond:
                break
            # Manifest first: a reader must never be sent to a folder that is gone.
            files.delete(files.manifest_path(self.batches_path, number))
            if row["path"]:
                files.delete(f"{self.markers_path}/{row['path']}")
                files.delete(f"{self.events_path}/{row['path']}")
            kept_rows, kept_bytes = kept_rows - row["rows"], kept_bytes - (row["bytes"] or 0)
            removed += 1
        return removed

    def remove_leftovers(self) -> int:
        """Remove folders of attempts that died before their manifest. Not while a capture runs."""
        named = {r["path"] for r in self.batches().select("path").collect()}
        stray = [f for f in files.subfolders(self.events_path) if f not in named]
        for name in stray:
            files.delete(f"{self.markers_path}/{name}")
            files.delete(f"{self.events_path}/{name}")
        return len(stray)

    def size(self) -> DataFrame:
        """``batches, rows, bytes`` that the log holds, from its manifests."""
        return self.batches().agg(
            F.count_if(F.col("rows") > 0).alias("batches"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))

    # --- short cuts ---

    def changes(self, **where) -> DataFrame:
        return self.read(**where).filter(F.col("type") == CHANGE)


def _within(
    rows: DataFrame, table_id: int | None = None, after: int | None = None, upto: int | None = None,
    min_snapshot: int | None = None,
) -> DataFrame:
    for value, test in (
        (table_id, F.col("table_id") == F.lit(table_id)), (after, F.col("seq") > F.lit(after)),
        (upto, F.col("seq") <= F.lit(upto)), (min_snapshot, F.col("snapshot_id") >= F.lit(min_snapshot)),
    ):
        if value is not None:
            rows = rows.filter(test)
    return rows
