"""Subscriptions: handlers that receive the changes of one table, batch by batch."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtide.functions.events import CHANGE, SCHEMA_CHANGED, decode_row
from rowtide.operators.pairs import FEED_LENGTH, feed, halves, merged_feed, newest_entries, typed_changes
from rowtide.operators.positions import check_position
from rowtide.operators.sequence import running_count
from rowtide.schemas import BATCHES
from rowtide.settings import local_table, scratch_scope, tracked_dir
from rowtide.sources import files
from rowtide.sources.log import EventLog
from rowtide.sources.manifests import in_steps, manifest_stream
from rowtide.sources.newest import NewestEntries
from rowtide.streaming.follow import BATCHES_AT_ONCE, ordinal_before


class Subscription:
    """Calls handlers with DataFrames; ``position`` is the last sequence handled.

    Within a batch the handlers are called in log order: changes up to a marker, the marker, the
    changes after it. Nothing is delivered after a drop. The position is saved once the handlers of
    a batch have returned, so a crash repeats a batch and loses none.
    """

    def __init__(self, log: EventLog, table_id: int, state_path: str, start_after: int | None = None):
        self.log, self.table_id, self.state_path = log, table_id, state_path.rstrip("/")
        self._changed: Callable[[DataFrame], None] = lambda changes: None
        self._reshaped: Callable[[list[str] | None], None] = lambda columns: None
        self._dropped: Callable[[], None] = lambda: None
        newest = log.newest()
        saved = self._load()
        if saved is None:
            saved = {
                "position": newest["last_seq"] if start_after is None else start_after,
                "log_id": newest["log_id"], "ended": False,
            }
            self._save(saved)
        check_position(saved["position"], log.first_seq(), newest["last_seq"], saved["log_id"], newest["log_id"])

    @property
    def spark(self) -> SparkSession:
        return self.log.spark

    @property
    def position(self) -> int:
        return self._load()["position"]

    @property
    def ended(self) -> bool:
        return self._load()["ended"]

    def _load(self) -> dict | None:
        path = f"{self.state_path}/position.json"
        return files.read_json(path)[0] if files.exists(path) else None

    def _save(self, state: dict) -> None:
        files.write_json(f"{self.state_path}/position.json", [state])

    # --- handlers ---

    def on_change(self, handler):
        """``handler(changes)``: ``seq, type, snapshot, rowid, row, before``, rows as maps. A batch
        that holds nothing but the first halves of updates gives an empty DataFrame."""
        self._changed = handler
        return handler

    def on_schema_change(self, handler):
        """``handler(columns)`` is called between the changes before and after a new shape, with its column
        names, or None where the marker names none."""
        self._reshaped = handler
        return handler

    def on_table_dropped(self, handler):
        """``handler()`` is called once, after the last change that will ever be delivered."""
        self._dropped = handler
        return handler

    # --- delivery ---

    def changes(self, events: DataFrame, after: int) -> DataFrame:
        """Typed changes of events after a position. If the position lies between the two halves of
        updates, their first halves are fetched from the log: only the one snapshot the position
        lies in can be cut, and it lies in one batch."""
        cut = events.filter(F.col("type") == CHANGE).orderBy("seq").select("snapshot_id").limit(1).collect()
        complete = events
        if cut:
            before = halves(self.log.read(self.table_id, upto=after, min_snapshot=cut[0]["snapshot_id"]))
            complete = events.unionByName(before.filter(F.col("snapshot_id") == cut[0]["snapshot_id"]))
        return typed_changes(complete).filter(F.col("seq") > after)

    @staticmethod
    def _stretches(rows: DataFrame, markers: DataFrame) -> DataFrame:
        """``rows`` with ``stretch``, the number of markers before each: markers are put among the rows and
        counted along the order, a piece of it at a time, so their number does not matter to a row."""
        places = markers.select("seq", F.lit(True).alias("_marker"))
        both = rows.withColumn("_marker", F.lit(False)).unionByName(places, allowMissingColumns=True).withColumn("_log", F.lit(0))
        counted = running_count(both, ["_log"], "seq", F.col("_marker"), "stretch")
        return counted.filter(~F.col("_marker")).select(*rows.columns, "stretch")

    def deliver(self, batches: list) -> None:
        """Hand published batches to the handlers; those handled before are left out."""
        state = self._load()
        new = [b for b in batches if b["last_seq"] > state["position"]]
        if state["ended"] or not new:
            return
        after, upto = state["position"], max(b["last_seq"] for b in new)
        events = self.log.read_paths([b["path"] for b in new if b["rows"]], self.table_id, after=after)
        # One marker per change of shape: bounded by the commits of a batch.
        found = self.log.markers_in(new, self.table_id).filter(F.col("seq") > after)
        markers = found.select("seq", "type", "columns").orderBy("seq").collect()  # each is one call of a handler
        changes = self.changes(events, after)
        held = events.filter(F.col("type") == CHANGE)
        with scratch_scope():
            if not markers:
                filled, parts = (set() if held.isEmpty() else {0}), {0: changes}
            else:  # pair once, and give each stretch between markers its folder
                filled = {r["stretch"] for r in self._stretches(held.select("seq"), found).select("stretch").distinct().collect()}
                path = tracked_dir(self.spark, "stretches")
                self._stretches(changes, found).write.partitionBy("stretch").parquet(path)
                read = self.spark.read.schema(changes.schema)
                written = {int(n.split("=")[1]) for n in files.subfolders(path) if n.startswith("stretch=")}
                parts = {n: read.parquet(f"{path}/stretch={n}") for n in written}
            for number, marker in enumerate([*markers, None]):
                if number in filled:
                    self._hand_over(parts[number] if number in parts else changes.limit(0))
                if marker is None:
                    break
                if marker["type"] == SCHEMA_CHANGED:
                    self._reshaped(marker["columns"])
                else:
                    self._dropped()
                    self._save({**state, "position": marker["seq"], "ended": True})
                    return
        self._save({**state, "position": upto})

    def _on_batch(self, batch: DataFrame, _: int) -> None:
        for some in in_steps(batch, "ordinal", BATCHES_AT_ONCE):
            self.deliver(some)

    def _hand_over(self, changes: DataFrame) -> None:
        self._changed(changes.select(
            "seq", "table_id", "type", "snapshot", "rowid", decode_row("row").alias("row"),
            decode_row("before").alias("before"),
        ))

    def start(self, checkpoint: str, interval: str | None = None):
        after = ordinal_before(self.log, self.position)
        stream = manifest_stream(self.spark, self.log.batches_path, BATCHES, after)
        writer = stream.writeStream.foreachBatch(self._on_batch)
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def run_available(self, checkpoint: str) -> int:
        self.start(checkpoint).awaitTermination()
        return self.position


def activity_feed(log: EventLog, table_id: int, after: int = 0, length: int = FEED_LENGTH) -> DataFrame:
    """The newest entries of one table, newest first.

    Every batch keeps its newest entries, and the feed merges those of the newest batches: each has an event of
    the table, and an entry has two events at most, so ``2 * length`` batches are enough. Batches are opened
    when they are asked about for the first time, and the one that ``after`` cuts. Where an update among the
    entries lacks a half, or copies leave too few entries, the log itself is asked."""
    newest = log.newest_batches(table_id, after, 2 * length)  # metadata of so many batches at most
    token = lambda b: b["path"].removeprefix("batch=")
    whole = [token(b) for b in newest if b["first_seq"] > after]
    cut = log.in_batches([token(b) for b in newest if b["first_seq"] <= after], table_id, after)
    entries = newest_entries(cut, length, "batch").drop("batch")
    if whole:
        kept = NewestEntries(log.spark, f"{log.path}/newest", table_id, length)
        entries = entries.unionByName(kept.of(whole, lambda some: log.in_batches(some, table_id)))
    found = merged_feed(entries, length)
    rows = found.collect()  # `length` entries
    if not all(r["whole"] for r in rows) or (len(rows) < length and len(newest) == 2 * length):
        return _feed_from_log(log, table_id, after, length)
    return local_table(log.spark, [tuple(r) for r in rows], found.schema).drop("whole").orderBy(F.desc("seq"))


def _feed_from_log(log: EventLog, table_id: int, after: int, length: int) -> DataFrame:
    """Only events of the newest snapshots that hold ``2 * length`` of them can be among the entries: counting
    narrow columns finds the snapshot from which to read."""
    events = log.read(table_id, after=after)
    newest = events.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("snapshot_id"))
    enough, low = 0, None
    for row in newest.limit(2 * length).collect():  # at most that many numbers
        enough, low = enough + row["n"], row["snapshot_id"]
        if enough >= 2 * length:
            break
    return feed(log.read(table_id, after=after, min_snapshot=low), length)
