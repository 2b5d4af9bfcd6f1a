"""Capture: commits of versioned tables become events on the log, in order, losing none."""

from collections import defaultdict

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from rowtide.functions.events import SCHEMA_CHANGED, TABLE_DROPPED, change_events, marker_events
from rowtide.operators.diff import deletes, inserts, snapshot_diff, with_rowid
from rowtide.schemas import COMMITS, EVENT
from rowtide.settings import local_table
from rowtide.sources import files
from rowtide.sources.lake import Lake, NoSuchTable, in_shape, retyped_columns, shape_of
from rowtide.sources.log import EventLog
from rowtide.sources.manifests import HistoryRemoved, in_steps, manifest_stream

_MARKER = (
    "type string, table_id long, table string, snapshot_id long, columns array<string>, schema_json string, "
    "retyped array<string>, snapshot_time timestamp"
)


def boundary_markers(commits: list[Row]) -> list[tuple]:
    """Markers the commits call for: where a table's shape changed, and where it was dropped."""
    found = []
    for c in commits:
        if c["op"] == "drop":
            found.append((TABLE_DROPPED, c["table_id"], c["table"], c["snapshot_id"], None, None, None, c["snapshot_time"]))
        elif c["previous_schema_json"] and c["previous_schema_json"] != c["schema_json"]:
            retyped = retyped_columns(shape_of(c["previous_schema_json"]), shape_of(c["schema_json"]))
            found.append((SCHEMA_CHANGED, c["table_id"], c["table"], c["snapshot_id"], c["columns"],
                          c["schema_json"], retyped, c["snapshot_time"]))
    return found


class Capture:
    """Moves the commits of a lake to a log.

    ``tables`` names the tables to follow (None: all). A followed table keeps being followed under a
    new name, and a table created again under a followed name is taken up at the snapshot that
    created it, with its new id. ``max_commits`` bounds how many snapshots one log batch covers.
    """

    def __init__(self, lake: Lake, log: EventLog, tables: list[str] | None = None, max_commits: int = 500):
        self.lake, self.log, self.names, self.max_commits = lake, log, tables, max_commits
        self._ids: set[int] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.lake.spark

    # --- which tables ---

    def _followed_ids(self, upto: int) -> set[int]:
        """Ids that are, or were created, under a followed name up to a snapshot."""
        past = self.lake.commits().filter((F.col("snapshot_id") <= upto) & F.col("table").isin(self.names))
        ids = {r["table_id"] for r in past.filter("op = 'create'").select("table_id").distinct().collect()}
        for name in self.names:
            try:
                ids.add(self.lake.table_id(name, upto))
            except NoSuchTable:
                pass
        return ids

    def _followed(self, commits: list[Row], cursor: int) -> list[Row]:
        if self.names is None:
            return commits
        if self._ids is None:
            self._ids = self._followed_ids(cursor)
        kept = []
        for c in sorted(commits, key=lambda c: c["snapshot_id"]):
            if c["op"] == "create" and c["table"] in self.names:
                self._ids.add(c["table_id"])
            if c["table_id"] in self._ids:
                kept.append(c)
        return kept

    # --- commits to events ---

    def events_of(self, commits: list[Row]) -> DataFrame:
        """Events of a list of commit rows: one lazy plan per table and shape, whatever the number
        of commits, over the parts the commits added and removed and nothing else."""
        groups: dict[tuple, list[Row]] = defaultdict(list)
        for c in commits:
            if c["op"] not in ("none", "drop") and (c["parts_added"] or c["parts_removed"]):
                groups[(c["table_id"], c["schema_json"], c["previous_schema_json"], tuple(c["key"]))].append(c)
        marked = boundary_markers(commits)
        events = marker_events(local_table(self.spark, marked, _MARKER), self.log.prefix) if marked else None
        for (table_id, schema, previous, key), group in groups.items():
            changes = self._group_changes(table_id, schema, previous, list(key), group)
            found = change_events(changes, self.log.prefix)
            events = found if events is None else events.unionByName(found)
        return events if events is not None else local_table(self.spark, [], EVENT)

    def _group_changes(self, table_id: int, schema_json: str, previous: str | None, key: list[str], group: list[Row]) -> DataFrame:
        shape = shape_of(schema_json)
        old_shape = shape_of(previous) if previous else shape
        both = [c for c in group if c["parts_added"] and c["parts_removed"]]
        only_new = [c for c in group if not c["parts_removed"]]
        only_old = [c for c in group if not c["parts_added"]]

        def new_rows(some: list[Row]) -> DataFrame:
            parts = [p for c in some for p in c["parts_added"]]
            rows = self.lake.read_parts(table_id, shape, parts, keep=True)
            return with_rowid(rows.withColumnRenamed("_added", "snapshot_id").drop("_bucket"), key, ["snapshot_id"])

        def old_rows(some: list[Row]) -> DataFrame:
            removed = [(*map(int, p.split("/")), c["snapshot_id"]) for c in some for p in c["parts_removed"]]
            parts = sorted({f"{s}/{b}" for s, b, _ in removed})
            rows = self.lake.read_parts(table_id, old_shape, parts, keep=True)
            if len(some) == 1:
                rows = rows.withColumn("snapshot_id", F.lit(some[0]["snapshot_id"]).cast("long"))
            else:  # a part is removed once at most, so this adds a column and no rows
                by = local_table(self.spark, removed, "_added long, _bucket int, snapshot_id long")
                rows = rows.join(by, ["_added", "_bucket"])
            return with_rowid(in_shape(rows, old_shape, shape, ["snapshot_id"]), key, ["snapshot_id"])

        kept = ["snapshot_id"]
        pieces = []
        if only_new:
            pieces.append(inserts(new_rows(only_new), kept))
        if only_old:
            pieces.append(deletes(old_rows(only_old), kept))
        if both:
            pieces.append(snapshot_diff(old_rows(both), new_rows(both), kept))
        changes = pieces[0]
        for piece in pieces[1:]:
            changes = changes.unionByName(piece)
        if len(group) == 1:
            c = group[0]
            named = changes.withColumn("table", F.lit(c["table"])).withColumn("snapshot_time", F.lit(c["snapshot_time"]))
        else:  # one row per commit of the batch: at most max_commits
            by = local_table(
                self.spark, [(c["snapshot_id"], c["table"], c["snapshot_time"]) for c in group],
                "snapshot_id long, table string, snapshot_time timestamp",
            )
            named = changes.join(by, "snapshot_id")
        return named.withColumn("table_id", F.lit(table_id).cast("long"))

    # --- publishing ---

    def publish_commits(self, commits: list[Row]) -> int:
        """Publish the commits the log does not cover yet; gives the number of events.

        The newest batch manifest, not the stream's own bookkeeping, decides what is left to do, so
        a repeated or restarted batch stores nothing twice and skips nothing."""
        cursor = self.log.newest()["end_snapshot"]
        todo = sorted((c for c in commits if c["snapshot_id"] > cursor), key=lambda c: c["snapshot_id"])
        if not todo:
            return 0
        if todo[0]["snapshot_id"] > cursor + 1:
            raise HistoryRemoved(f"commits {cursor + 1} to {todo[0]['snapshot_id'] - 1} are missing")
        published = 0
        snapshots = sorted({c["snapshot_id"] for c in todo})
        for start in range(0, len(snapshots), self.max_commits):
            span = snapshots[start:start + self.max_commits]
            chunk = [c for c in todo if span[0] <= c["snapshot_id"] <= span[-1]]
            followed = self._followed(chunk, span[0] - 1)
            marked = bool(boundary_markers(followed))
            published += self.log.publish(self.events_of(followed), span[0], span[-1], distinct=True, marked=marked)["rows"]
        return published

    # --- the stream ---

    def open(self, starting: str | int = "latest") -> int:
        """Make the log on first start, at the lake's newest snapshot, at its beginning or at a
        given one, and give the snapshot to read after."""
        if not self.log.exists():
            at = {"latest": self.lake.head, "earliest": lambda: 0}.get(starting, lambda: int(starting))()
            if self.names is not None:
                missing = [n for n in self.names if not self._known(n)]
                if missing:
                    raise ValueError(f"no such table: {', '.join(missing)}")
            self.log.create(at)
        cursor = self.log.newest()["end_snapshot"]
        self._check_history(cursor)
        return cursor

    def _known(self, name: str) -> bool:
        return bool(self.lake.commits().filter(F.col("table") == name).limit(1).count())

    def _check_history(self, cursor: int) -> None:
        """Commits after the cursor must still be there."""
        numbers = files.manifest_numbers(self.lake.commits_path)
        if numbers and numbers[0] > cursor + 1:
            raise HistoryRemoved(f"commits {cursor + 1} to {numbers[0] - 1} were cleaned up before they were captured")

    def start(self, checkpoint: str, starting: str | int = "latest", interval: str | None = None):
        """Start the stream: with ``interval`` it keeps running, otherwise it takes what is there
        and ends."""
        cursor = self.open(starting)
        stream = manifest_stream(self.spark, self.lake.commits_path, COMMITS, cursor)
        # Only commit manifests come to the driver here, max_commits at a time; rows stay on the executors.
        writer = stream.writeStream.foreachBatch(self._on_batch)
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def _on_batch(self, batch: DataFrame, _: int) -> None:
        for commits in in_steps(batch, "snapshot_id", self.max_commits):
            self.publish_commits(commits)

    def run_available(self, checkpoint: str, starting: str | int = "latest") -> None:
        self.start(checkpoint, starting).awaitTermination()


def rebuild_log(lake: Lake, path: str, checkpoint: str, prefix: str = "changes", starting: int = 0) -> EventLog:
    """Publish the lake's history again to a new log. Its ``log_id`` differs, so that readers of the
    lost log notice."""
    log = EventLog(lake.spark, path, prefix)
    Capture(lake, log).run_available(checkpoint, starting)
    return log
