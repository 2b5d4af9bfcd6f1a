"""A reader's view and position on disk: base rows, the changes since, and the shape to show them in.

    <state>/versions/<n>.json                   position, flags, folders of the base and of the deltas, touched columns
    <state>/data/version=<n>-<x>/bucket=<b>     base rows
    <state>/data/delta=<n>-<x>                  last changes per row of some batches, deleted rows as such

A version names the folders it consists of. Taking up a batch writes its changes as one delta, or nothing where it
has only markers: these go to the version file, as the last removal and touch of every column name, and are applied
when rows are read. A crash leaves the version before, complete.

Reading puts the deltas, whose newest change per row counts, before the base. Deltas of like size are merged when
there are ``fan`` of them, so there are few; when all together outgrow a quarter of the base, the buckets they touch
are written anew. A row is thus rewritten a bounded number of times for every row that changes.
"""

import datetime as dt
import math
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowtide.operators.view import reshape
from rowtide.schemas import TOUCHED, VIEW, conform
from rowtide.settings import check_path, local_table
from rowtide.sources import files

_STORED = T.StructType(VIEW.fields + [T.StructField("version", T.StringType()), T.StructField("bucket", T.IntegerType())])
_DELTA = T.StructType(VIEW.fields + [T.StructField("gone", T.BooleanType())])
_KEY = ["table_id", "rowid", "rowkey"]
_BASE_SHARE = 4  # deltas may be as large as the base by this


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("rowid"), F.lit(buckets)).cast("int")


class ViewStore:
    """``keep_for`` is how long a version stays readable after a newer one took its place: longer than any read
    of it lasts. ``buckets`` should grow with the table, so that one is a few hundred megabytes at most. Deltas of
    less than ``compact_from`` bytes together stay beside the base, however small that is. Of two readers that save
    to one store at once the later one fails with ``AlreadyThere``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, keep_for: dt.timedelta = dt.timedelta(hours=6),
                 compact_from: int = 64 * 1024 * 1024, fan: int = 8):
        self.spark, self.path, self.buckets, self.keep_for = spark, check_path(spark, path), buckets, keep_for
        self.compact_from, self.fan = compact_from, fan
        self._versions = f"{self.path}/versions"

    def load(self) -> dict | None:
        """Newest version, or None where nothing was saved."""
        numbers = files.manifest_numbers(self._versions)
        return files.read_json(files.manifest_path(self._versions, numbers[-1]))[0] if numbers else None

    def rows(self, state: dict | None = None) -> DataFrame:
        """Rows of a version in its shape."""
        state = (state if state is not None else self.load()) or {}
        rows = self._merged(list(state.get("folders", {}).values()), state.get("deltas", []))
        if state.get("touched"):
            rows = reshape(rows, local_table(self.spark, [(state["table_id"], state["touched"])], TOUCHED))
        return conform(rows, VIEW)

    def _base(self, folders: list[str]) -> DataFrame:
        if not folders:
            return local_table(self.spark, [], VIEW)
        base = f"{self.path}/data"
        read = self.spark.read.schema(_STORED).option("basePath", base).parquet(*[f"{base}/{p}" for p in folders])
        return read.select(VIEW.fieldNames())

    def _last(self, deltas: list[dict]) -> DataFrame:
        """The newest change of every row in some deltas."""
        found = self.spark.read.schema(_DELTA).parquet(*[f"{self.path}/data/{d['path']}" for d in deltas])
        if len(deltas) == 1:  # a delta has a row once
            return found
        newest = F.max_by(F.struct("row", "seq", "gone"), F.col("seq"))
        return found.groupBy(*_KEY).agg(newest.alias("n")).select(*_KEY, "n.*")

    def _merged(self, folders: list[str], deltas: list[dict]) -> DataFrame:
        """Base rows that no delta changes, and what the deltas leave of the others. The base is not shuffled where
        the changed keys are few enough to be sent to it, which adaptive execution decides."""
        base = self._base(folders)
        if not deltas:
            return base
        last = self._last(deltas)
        changed = last.filter(~F.col("gone")).select(VIEW.fieldNames())
        return base.join(last.select(*_KEY), _KEY, "left_anti").unionByName(changed) if folders else changed

    # --- saving ---

    def save(self, state: dict, rows: DataFrame | None = None) -> dict:
        """New version with the given rows in place of all earlier ones, or with the rows there are."""
        before = self._before(state)
        if rows is not None:
            before = {"buckets": before["buckets"], "version": before["version"], **self._rebased(before, rows, None)}
            state = {**state, "deltas": [], "touched": []}
        return self._put({**state, **before, **{k: state[k] for k in ("deltas", "touched") if k in state}})

    def take(self, state: dict, changes: DataFrame | None, touched: list[dict]) -> dict:
        """New version of ``state`` with some changes more (``last`` of a digest; None: there are none) and
        the list of touched columns after them."""
        before = self._before(state)
        found = {**state, **before, "touched": touched}
        if changes is not None:
            folder = f"delta={before['version'] + 1:012d}-{uuid.uuid4().hex}"
            gone = (F.col("change_type") == "delete").alias("gone")
            changes.select(*VIEW.fieldNames(), gone).write.parquet(f"{self.path}/data/{folder}")
            found["deltas"] = [*before["deltas"], {"path": folder, "bytes": files.folder_bytes(f"{self.path}/data/{folder}")}]
        return self._put(self._compacted(found))

    def _before(self, state: dict) -> dict:
        """What the newest version consists of. A state read before that one was saved is refused."""
        newest = self.load() or {"version": 0, "buckets": self.buckets}
        if state.get("version", newest["version"]) != newest["version"]:
            raise files.AlreadyThere(f"{self._versions}: version {newest['version']} was saved by another reader")
        parts = {"folders": {}, "sizes": {}, "deltas": [], "touched": []}
        return {k: newest.get(k, parts.get(k)) for k in ("version", "buckets", *parts)}

    def _put(self, state: dict) -> dict:
        state = {**state, "version": state["version"] + 1, "saved_at": _now().isoformat()}
        files.write_json(files.manifest_path(self._versions, state["version"]), [state], True)
        self._drop_old()
        return state

    def _rebased(self, state: dict, rows: DataFrame, touched: list[int] | None) -> dict:
        """Write rows as the base of the touched buckets (None: of all); gives ``folders`` and ``sizes``."""
        folder = f"version={state['version'] + 1:012d}-{uuid.uuid4().hex}"
        stored = conform(rows, VIEW).withColumn("bucket", bucket_of(state["buckets"])).hint("rebalance", "bucket")
        stored.write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        kept = set() if touched is None else set(state["folders"]) - {str(b) for b in touched}
        folders = {b: p for b, p in state["folders"].items() if b in kept}
        sizes = {b: n for b, n in state["sizes"].items() if b in kept}
        for name in files.subfolders(f"{self.path}/data/{folder}"):
            bucket = name.split("=")[1]
            folders[bucket] = f"{folder}/{name}"
            sizes[bucket] = files.folder_bytes(f"{self.path}/data/{folder}/{name}")
        return {"folders": folders, "sizes": sizes}

    # --- keeping the deltas few and small ---

    def _compacted(self, state: dict) -> dict:
        deltas = state["deltas"]
        if not deltas:
            return state
        base = sum(state["sizes"].values())
        if not base or sum(d["bytes"] for d in deltas) > max(self.compact_from, base // _BASE_SHARE):
            last = self._last(deltas)
            hit = sorted(r["b"] for r in last.select(bucket_of(state["buckets"]).alias("b")).distinct().collect())  # at most `buckets`
            folders = [p for b, p in state["folders"].items() if int(b) in hit]
            return {**state, **self._rebased(state, self._merged(folders, deltas), hit), "deltas": []}
        while (many := self._alike(deltas)) >= self.fan:
            folder = f"delta={state['version'] + 1:012d}-{uuid.uuid4().hex}"
            self._last(deltas[-many:]).select(_DELTA.fieldNames()).write.parquet(f"{self.path}/data/{folder}")
            deltas = [*deltas[:-many], {"path": folder, "bytes": files.folder_bytes(f"{self.path}/data/{folder}")}]
        return {**state, "deltas": deltas}

    def _alike(self, deltas: list[dict]) -> int:
        """How many of the newest deltas are of the newest one's size class or a smaller one."""
        unit = max(1, self.compact_from // self.fan**2)
        tiers = [int(math.log(max(d["bytes"], unit) / unit, self.fan)) for d in deltas]
        alike = 0
        for tier in reversed(tiers):
            if tier > tiers[-1]:
                break
            alike += 1
        return alike

    def _drop_old(self) -> None:
        """Versions replaced longer ago than ``keep_for`` go, with the folders only they name. The oldest are
        looked at first, and no more than are due."""
        numbers = files.manifest_numbers(self._versions)
        state = lambda n: files.read_json(files.manifest_path(self._versions, n))[0]
        for number, after in zip(numbers, numbers[1:]):
            follower = state(after)  # it took the place of `number` when it was saved
            if _now() - dt.datetime.fromisoformat(follower["saved_at"]) < self.keep_for:
                return
            # A folder is named by a run of versions, so one the next version lacks is in no later one.
            for folder in _named(state(number)) - _named(follower):
                files.delete(f"{self.path}/data/{folder}")
            files.delete(files.manifest_path(self._versions, number))


def _named(state: dict) -> set[str]:
    return {*state["folders"].values(), *(d["path"] for d in state["deltas"])}


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)
