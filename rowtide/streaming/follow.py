"""A reader that keeps its own copy of one table, from the log alone."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowtide.functions.events import CHANGE, decode_row, encode_row
from rowtide.operators.diff import with_rowid
from rowtide.operators.metrics import status, waiting
from rowtide.operators.positions import PositionTooOld, check_position
from rowtide.operators.view import digest, empty_view, merge_touched
from rowtide.schemas import BATCHES, VIEW_META
from rowtide.settings import local_table, scratch_scope
from rowtide.sources import files
from rowtide.sources.lake import Lake
from rowtide.sources.log import EventLog
from rowtide.sources.manifests import in_steps, manifest_stream
from rowtide.sources.viewstore import ViewStore


# Published batches a reader takes up together.
BATCHES_AT_ONCE = 500


class Follower:
    """Applies the events of one table to a stored view. View and position are saved together."""

    def __init__(self, log: EventLog, table_id: int, store: ViewStore):
        self.log, self.table_id, self.store = log, table_id, store
        self.query = None
        self.error: str | None = None

    @property
    def spark(self) -> SparkSession:
        return self.log.spark

    # --- position ---

    def _fresh(self, last_seq: int) -> dict:
        return {
            "table_id": self.table_id, "log_id": self.log.newest()["log_id"], "last_seq": last_seq,
            "read_upto": last_seq, "received": 0, "table": None, "columns": [], "schema_json": None,
            "needs_reload": False, "ended": False,
        }

    def open(self, start_after: int | None = None) -> dict:
        """State to go on from: the saved one, else a new one at the end of the log or after a
        given position. A position the log cannot serve any more is refused."""
        newest = self.log.newest()
        state = self.store.load()
        if state is None:
            state = self._fresh(newest["last_seq"] if start_after is None else start_after)
        check_position(
            state["read_upto"], self.log.first_seq(), newest["last_seq"], state["log_id"], newest["log_id"]
        )
        if "version" not in state:
            state = self.store.save(state)
        return state

    def start_over(self) -> dict:
        """Empty view, position at the end of the log."""
        self.disconnect()
        self.error = None
        return self.store.save(self._fresh(self.log.head()), rows=empty_view(self.spark))

    def reload(self, lake: Lake, snapshot: int | None = None) -> dict:
        """Take the view from the table itself as of a snapshot the log covers, and go on from the
        last event of that snapshot."""
        newest = self.log.newest()
        snapshot = newest["end_snapshot"] if snapshot is None else snapshot
        position = newest["last_seq"]
        if snapshot < newest["end_snapshot"]:
            held = self.log.batches().filter(F.col("start_snapshot") <= snapshot)
            last = held.orderBy(F.desc("ordinal")).limit(1).first()
            inside = self.log.read_paths([last["path"]] if last["path"] else []).filter(F.col("snapshot_id") <= snapshot)
            position = inside.agg(F.max("seq").alias("s")).first()["s"] or last["first_seq"] - 1
        state = lake.state(self.table_id, snapshot)
        fresh = self._fresh(position)
        fresh.update(table=state.table, columns=state.schema.names, schema_json=state.schema.json())
        rows = lake.read_parts(self.table_id, state.schema, state.parts)
        rows = with_rowid(rows, state.key)
        rows = rows.select(
            F.lit(self.table_id).cast("long").alias("table_id"), "rowid", "rowkey",
            decode_row(encode_row(rows, "row")).alias("row"), F.lit(position).cast("long").alias("seq"),
        )
        return self.store.save(fresh, rows=rows)

    # --- applying ---

    def apply(self, batches: list) -> dict:
        """Apply published batches to the stored view; those read before change nothing."""
        state = self.store.load() or self.open()
        new = [b for b in batches if b["last_seq"] > state["read_upto"]]
        if not new or state["ended"]:
            return state
        upto = max(b["last_seq"] for b in new)
        events = self.log.read_paths([b["path"] for b in new if b["rows"]], self.table_id, after=state["read_upto"])
        found = events.agg(
            F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"), F.count_if(F.col("type") == CHANGE).alias("changes"),
            F.max_by("table", F.when(F.col("table") != "", F.col("seq"))).alias("table"),
        ).first()
        if not found["n"]:
            return self.store.save({**state, "read_upto": upto})
        marked = found["changes"] < found["n"]
        meta = local_table(self.spark, [tuple(state[f] for f in VIEW_META.fieldNames())], VIEW_META)
        with scratch_scope():
            markers = self.log.markers_in(new, self.table_id).filter(F.col("seq") > state["read_upto"]) if marked else None
            news = digest(events, meta, distinct=True, markers_expected=marked, markers=markers)
            changed, touched = {"last_seq": found["last"]}, state.get("touched", [])
            if marked or not state["columns"]:  # else only the position moves
                changed = news.meta.filter(F.col("table_id") == self.table_id).first().asDict()
            if news.touched is not None:  # one entry per column name
                for row in news.touched.filter(F.col("table_id") == self.table_id).collect():
                    touched = merge_touched(touched, row["touched"])
            return self.store.take(
                {
                    **state, **changed, "read_upto": upto, "received": state["received"] + found["n"],
                    "table": found["table"] or state["table"],
                },
                news.last if found["changes"] else None, touched,
            )

    def _on_batch(self, batch: DataFrame, _: int) -> None:
        for some in in_steps(batch, "ordinal", BATCHES_AT_ONCE):
            self.apply(some)

    # --- the stream ---

    def start(self, checkpoint: str, start_after: int | None = None, interval: str | None = None):
        """Follow the log from the saved position; stop the query to disconnect."""
        state = self.open(start_after)
        after = ordinal_before(self.log, state["read_upto"])
        stream = manifest_stream(self.spark, self.log.batches_path, BATCHES, after)
        writer = stream.writeStream.foreachBatch(self._on_batch)
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        self.query = writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
        return self.query

    def run_available(self, checkpoint: str, start_after: int | None = None) -> dict:
        self.start(checkpoint, start_after).awaitTermination()
        return self.store.load()

    def disconnect(self) -> None:
        """Stop reading; the position stays."""
        if self.query is not None:
            self.query.stop()
            self.query = None

    def reconnect(self, checkpoint: str, interval: str | None = None):
        """Go on from the saved position. One too old is reported in the status, not raised."""
        try:
            query = self.start(checkpoint, interval=interval)
        except PositionTooOld as error:
            self.error = f"reload the table: {error}"
            return None
        self.error = None
        return query

    # --- what a reader sees ---

    def rows(self) -> DataFrame:
        return self.store.rows()

    def status(self) -> DataFrame:
        """One record: state, position, lag behind the log and behind this table, flags, rows."""
        state = self.store.load() or self._fresh(self.log.head())
        head = self.log.head()
        mine = self.log.read(self.table_id, after=state["read_upto"]).agg(F.count(F.lit(1)).alias("waiting_table"))
        rows = self.store.rows(state).agg(F.count(F.lit(1)).alias("rows"))
        online = self.query is not None and self.query.isActive
        one = local_table(
            self.spark, [(self.error, state["ended"], online, self.table_id, state["table"] or "", f"{self.log.prefix}.{self.table_id}",
              state["received"], state["last_seq"], head, state["needs_reload"], state["columns"],
              mine.first()["waiting_table"], rows.first()["rows"])],
            "error string, ended boolean, online boolean, table_id long, table string, channel string, received long, "
            "last_seq long, head long, needs_reload boolean, columns array<string>, waiting_table long, rows long",
        )
        return one.select(
            status(F.col("error"), F.col("ended"), F.col("online")).alias("status"), "error", "table_id", "table",
            "channel", "received", "last_seq", "head", waiting(F.col("head"), F.col("last_seq")).alias("waiting"),
            "waiting_table", "needs_reload", "ended", "columns", "rows",
        )


def ordinal_before(log: EventLog, position: int) -> int:
    """Manifest number after which a reader at ``position`` has everything to read."""
    later = log.batches().filter((F.col("last_seq") > position) & (F.col("rows") > 0))
    first = later.agg(F.min("ordinal").alias("o")).first()["o"]
    return (first if first is not None else log.newest()["ordinal"] + 1) - 1
