"""Versioned tables: Parquet parts plus one commit manifest per snapshot.

    <lake>/commits/<snapshot>.json                              what each commit did
    <lake>/data/table_id=<t>/snapshot_id=<s>/bucket=<b>/*.parquet  rows, written once

A part is a folder named ``<s>/<b>``. A version of a table is the parts added up to a snapshot minus
those removed. Columns are stored under their id, so renaming, dropping or re-adding a column needs
no rewrite and can never bring old values back under a new column of the same name.
"""

import datetime as dt
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rowtide.operators.diff import INTEGRAL, duplicate_keys
from rowtide.schemas import COMMITS
from rowtide.settings import check_path, local_table
from rowtide.sources import files

_ID = "id"


class DuplicateKey(ValueError):
    """A version would hold two rows with one key."""


class NullKey(ValueError):
    """A row has no value in a key column."""


class NameInUse(ValueError):
    """There is a live table with that name."""


class NoSuchTable(ValueError):
    """The table does not exist at that snapshot."""


@dataclass
class TableState:
    table_id: int
    table: str
    schema: T.StructType
    key: list[str]
    parts: list[str] = field(default_factory=list)
    dropped: bool = False


@dataclass
class TableChange:
    """What one commit does to one table."""

    table_id: int
    table: str
    op: str
    schema: T.StructType
    key: list[str]
    add: DataFrame | None = None
    remove: list[str] = field(default_factory=list)
    previous: T.StructType | None = None
    created: bool = False


def with_column_ids(schema: T.StructType, known: T.StructType | None = None, renames: dict[str, str] | None = None,
                    highest: int = 0) -> T.StructType:
    """Give every column its id: a known column keeps it (also through ``renames``, new name → old
    name), any other gets one never used in the table before."""
    ids = {f.name: f.metadata[_ID] for f in known.fields} if known else {}
    renames = renames or {}
    fields, top = [], max([highest, *ids.values()])
    for f in schema.fields:
        old = renames.get(f.name, f.name)
        if old in ids:
            number = ids[old]
        else:
            top += 1
            number = top
        fields.append(T.StructField(f.name, widened(f.dataType), True, {_ID: number}))
    return T.StructType(fields)


def widened(dtype: T.DataType) -> T.DataType:
    """The type with nulls allowed at every depth, as stored rows are read."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, widened(f.dataType), True, f.metadata) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(widened(dtype.elementType), True)
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, widened(dtype.valueType), True)
    return dtype


def _renamed_key(state: "TableState", shape: T.StructType) -> list[str]:
    """Names that the key columns of a table have in a new shape."""
    names = {f.metadata[_ID]: f.name for f in shape.fields}
    kept = [names.get(state.schema[k].metadata[_ID]) for k in state.key]
    for old, new in zip(state.key, kept):
        if new is None:
            raise ValueError(f"{state.table}: {old} is part of the key and cannot be dropped")
        if new != old and not (len(kept) == 1 and isinstance(state.schema[old].dataType, INTEGRAL)):
            raise ValueError(f"{state.table}: {old} is part of a key that cannot be renamed")
    return kept


def shape_of(schema_json: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(schema_json))


def retyped_columns(old: T.StructType, new: T.StructType) -> list[str]:
    """Columns that kept their name but not their type."""
    types = {f.name: f.dataType for f in old.fields}
    return [f.name for f in new.fields if f.name in types and types[f.name] != f.dataType]


# Types Parquet readers widen on the fly: fixed pairs of (stored, read).
_WIDENINGS = {
    (T.ByteType, T.ShortType), (T.ByteType, T.IntegerType), (T.ByteType, T.LongType),
    (T.ShortType, T.IntegerType), (T.ShortType, T.LongType), (T.IntegerType, T.LongType),
    (T.IntegerType, T.DoubleType), (T.FloatType, T.DoubleType),
}


def in_shape(df: DataFrame, old: T.StructType, new: T.StructType, keep: list[str] = ()) -> DataFrame:
    """Rows of one shape in another: columns are matched by id, missing ones are NULL."""
    names = {f.metadata[_ID]: f.name for f in old.fields}

    def value(field: T.StructField):
        name = names.get(field.metadata[_ID])
        return F.lit(None) if name is None else F.col(f"`{name}`")

    return df.select(*keep, *[value(f).cast(f.dataType).alias(f.name) for f in new.fields])


class Lake:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 1):
        self.spark, self.path, self.buckets = spark, check_path(spark, path), buckets
        self._read_upto, self._states = 0, {}
        files.make_dir(self.commits_path)

    @property
    def commits_path(self) -> str:
        return f"{self.path}/commits"

    def table_path(self, table_id: int) -> str:
        return f"{self.path}/data/table_id={table_id}"

    # --- history ---

    def commits(self) -> DataFrame:
        return self.spark.read.schema(COMMITS).json(self.commits_path)

    def history(self, after: int) -> DataFrame:
        """Snapshots after one, ascending, with what they changed."""
        return self.commits().filter(F.col("snapshot_id") > after).select("snapshot_id", "changes").orderBy("snapshot_id")

    def head(self) -> int:
        numbers = files.manifest_numbers(self.commits_path)
        return numbers[-1] if numbers else 0

    def newest_state(self, table_id: int) -> TableState:
        """Name, shape and live parts of a table now. Only manifests that were not read before are opened, so
        a commit costs the same however long the history is."""
        if not self._read_upto:
            numbers = files.manifest_numbers(self.commits_path)
            self._read_upto = numbers[0] - 1 if numbers else 0
        head = files.present_after(self.commits_path, self._read_upto)
        for number in range(self._read_upto + 1, head + 1):
            for row in files.read_json(files.manifest_path(self.commits_path, number)):
                if row["op"] != "none":
                    old = self._states.get(row["table_id"])
                    gone = set(row["parts_removed"])
                    parts = [p for p in (old.parts if old else []) if p not in gone] + row["parts_added"]
                    dropped = row["op"] == "drop"
                    self._states[row["table_id"]] = TableState(
                        row["table_id"], row["table"], shape_of(row["schema_json"]), list(row["key"]),
                        [] if dropped else sorted(parts), dropped)
            self._read_upto = number
        if table_id not in self._states:
            raise NoSuchTable(f"there is no table {table_id}")
        return replace(self._states[table_id])

    def state(self, table_id: int, snapshot: int | None = None) -> TableState:
        """Name, shape and live parts of a table as of a snapshot."""
        if snapshot is None:
            return self.newest_state(table_id)
        mine = self.commits().filter(
            (F.col("table_id") == table_id) & (F.col("op") != "none") & (F.col("snapshot_id") <= snapshot))
        last = mine.orderBy(F.desc("snapshot_id")).limit(1).collect()
        if not last:
            raise NoSuchTable(f"table {table_id} does not exist at snapshot {snapshot}")
        removed = mine.select(F.explode("parts_removed").alias("part"))
        live = mine.select(F.explode("parts_added").alias("part")).join(removed, "part", "left_anti")
        parts = [] if last[0]["op"] == "drop" else sorted(r["part"] for r in live.collect())
        row = last[0]
        return TableState(table_id, row["table"], shape_of(row["schema_json"]), list(row["key"]), parts, row["op"] == "drop")

    def table_id(self, name: str, snapshot: int | None = None) -> int:
        """Id of the live table with this name."""
        found = self._live_names(snapshot).filter(F.col("table") == name).select("table_id").collect()
        if not found:
            raise NoSuchTable(f"there is no table {name}")
        return found[0]["table_id"]

    def columns_at(self, table_id: int, snapshot: int) -> list[str] | None:
        """Column names at a snapshot, None where the table cannot be read."""
        try:
            state = self.state(table_id, snapshot)
        except NoSuchTable:
            return None
        return None if state.dropped else state.schema.names

    def read_parts(self, table_id: int, schema: T.StructType, parts: list[str], keep: bool = False) -> DataFrame:
        """Rows of parts under the given shape; ``keep`` adds ``_added`` and ``_bucket``."""
        extra = [F.col("snapshot_id").alias("_added"), F.col("bucket").alias("_bucket")] if keep else []
        stored = T.StructType(
            [T.StructField(f"c{f.metadata[_ID]}", f.dataType) for f in schema.fields]
            + [T.StructField("snapshot_id", T.LongType()), T.StructField("bucket", T.IntegerType())]
        )
        named = [F.col(f"c{f.metadata[_ID]}").alias(f.name) for f in schema.fields]
        if not parts:
            return local_table(self.spark, [], stored).select(*extra, *named)
        base = self.table_path(table_id)
        paths = [f"{base}/snapshot_id={s}/bucket={b}" for s, b in (p.split("/") for p in parts)]
        return self.spark.read.schema(stored).option("basePath", base).parquet(*paths).select(*extra, *named)

    def read_version(self, table_id: int, snapshot: int | None = None) -> DataFrame:
        """The table as of a snapshot."""
        state = self.state(table_id, snapshot)
        if state.dropped:
            raise NoSuchTable(f"table {table_id} was dropped")
        return self.read_parts(table_id, state.schema, state.parts)

    # --- commits ---

    def commit(self, changes: list[TableChange], time: dt.datetime | None = None, validate: bool = True) -> int:
        """Write the parts, then the manifest that makes them a snapshot.

        Tables that the commit creates get their ids here. A commit does one thing to a table. Of two
        commits made at once, the one whose manifest comes later fails with ``AlreadyThere``."""
        snapshot = self.head() + 1
        self._place(changes)
        created = [c.table for c in changes if c.created]
        written = [self._write(c, snapshot, validate) if c.add is not None else [] for c in changes]
        time = time or dt.datetime.now(dt.timezone.utc)  # when the snapshot comes into being
        rows = []
        for change, parts in zip(changes, written):
            rows.append({
                "snapshot_id": snapshot, "snapshot_time": time, "table_id": change.table_id, "table": change.table,
                "op": change.op, "schema_json": change.schema.json(),
                "previous_schema_json": change.previous.json() if change.previous else None,
                "columns": change.schema.names, "key": change.key,
                "parts_added": parts, "parts_removed": list(change.remove),
                "changes": {"tables_created": created} if created else {},
            })
        if not rows:  # an empty commit still is a snapshot
            rows = [{"snapshot_id": snapshot, "snapshot_time": time, "op": "none", "changes": {}}]
        files.write_json(files.manifest_path(self.commits_path, snapshot), rows, new=True)
        return snapshot

    def _place(self, changes: list[TableChange]) -> None:
        """Give created tables their ids, and refuse what would not leave one table per id and name."""
        created = [c for c in changes if c.created]
        named = [c for c in changes if c.created or c.op == "rename"]
        if created:
            top = self.commits().agg(F.coalesce(F.max("table_id"), F.lit(0)).alias("t")).first()["t"]
            for number, change in enumerate(created, top + 1):
                change.table_id = number
        ids = [c.table_id for c in changes]
        if len(set(ids)) < len(ids):
            raise ValueError("a commit can change a table once only")
        wanted = [c.table for c in named]
        if len(set(wanted)) < len(wanted):
            raise NameInUse(f"two tables would be called {next(n for n in wanted if wanted.count(n) > 1)}")
        if named:
            leaving = {c.table_id for c in changes if c.op in ("drop", "rename")}
            for row in self._live_names().filter(F.col("table").isin(wanted)).collect():  # one per new name at most
                if row["table_id"] not in leaving:
                    raise NameInUse(f"there is a table {row['table']} already")

    def _live_names(self, snapshot: int | None = None) -> DataFrame:
        """``table_id, table`` of the tables that exist."""
        known = self.commits().filter(F.col("op") != "none")
        if snapshot is not None:
            known = known.filter(F.col("snapshot_id") <= snapshot)
        last = known.groupBy("table_id").agg(F.max_by(F.struct("table", "op"), "snapshot_id").alias("l"))
        return last.filter(F.col("l.op") != "drop").select("table_id", "l.table")

    def _write(self, change: TableChange, snapshot: int, validate: bool) -> list[str]:
        df = change.add.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in change.schema.fields])
        if validate:
            empty = F.lit(False)
            for name in change.key:
                empty = empty | F.col(f"`{name}`").isNull()
            if not df.filter(empty).isEmpty():
                raise NullKey(f"{change.table}: a row has no key")
            twice = duplicate_keys(df, change.key).limit(1).collect()
            if twice:
                raise DuplicateKey(f"{change.table}: key {twice[0].asDict()} occurs more than once")
        bucket = F.lit(0)
        if self.buckets > 1:
            bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in change.key]), F.lit(self.buckets)).cast("int")
        if validate and not change.created:
            self._check_live_keys(change, df, bucket)
        stored = df.select(
            bucket.alias("bucket"), *[F.col(f"`{f.name}`").alias(f"c{f.metadata[_ID]}") for f in change.schema.fields]
        )
        if self.buckets > 1:  # few files per bucket; large buckets are split at run time
            stored = stored.hint("rebalance", "bucket")
        path = f"{self.table_path(change.table_id)}/snapshot_id={snapshot}"
        stored.write.mode("overwrite").partitionBy("bucket").parquet(path)
        return [f"{snapshot}/{name.split('=')[1]}" for name in files.subfolders(path) if name.startswith("bucket=")]

    def _check_live_keys(self, change: TableChange, df: DataFrame, bucket) -> None:
        """Keys of rows to be added must not be in the parts that stay. Only the parts of the buckets the
        rows go to are read, and only their key columns."""
        stays = [p for p in self.state(change.table_id).parts if p not in set(change.remove)]
        if not stays:
            return
        used = {r["b"] for r in df.select(bucket.alias("b")).distinct().collect()}  # at most `buckets` numbers
        parts = [p for p in stays if int(p.split("/")[1]) in used]
        if not parts:
            return
        shape = T.StructType([f for f in change.schema.fields if f.name in change.key])
        names = [F.col(f"`{k}`") for k in change.key]
        live = self.read_parts(change.table_id, shape, parts).select(*names)
        both = df.select(*names).join(live, change.key, "left_semi").limit(1).collect()
        if both:
            raise DuplicateKey(f"{change.table}: key {both[0].asDict()} is in the table already")

    def creation(self, name: str, df: DataFrame, key: list[str]) -> TableChange:
        """Change that creates a table. ``commit`` gives it an id that was never used."""
        schema = with_column_ids(df.schema)
        return TableChange(0, name, "create", schema, key, add=df, created=True)

    def create(self, name: str, df: DataFrame, key: list[str], time: dt.datetime | None = None) -> int:
        """Create a table with its first rows; gives the table id."""
        change = self.creation(name, df, key)
        self.commit([change], time)
        return change.table_id

    def _live(self, table_id: int) -> TableState:
        state = self.state(table_id)
        if state.dropped:
            raise NoSuchTable(f"table {table_id} was dropped; its id is never used again")
        return state

    def appending(self, table_id: int, df: DataFrame) -> TableChange:
        state = self._live(table_id)
        return TableChange(table_id, state.table, "data", state.schema, state.key, add=df)

    def replacing(self, table_id: int, df: DataFrame, parts: list[str] | None = None) -> TableChange:
        """Change that puts ``df`` in the place of some parts, by default of all."""
        state = self._live(table_id)
        return TableChange(table_id, state.table, "data", state.schema, state.key, add=df,
                           remove=state.parts if parts is None else parts)

    def altering(self, table_id: int, schema: T.StructType, renames: dict[str, str] | None = None,
                 df: DataFrame | None = None) -> TableChange:
        """Change of shape, with new contents if ``df`` is given. A changed type needs ``df``
        unless Parquet can widen the stored one. Key columns stay; the only column of an integer key may be renamed,
        others not, as their names are part of what identifies a row in the log."""
        state = self._live(table_id)
        highest = self._highest_column_id(table_id)
        shape = with_column_ids(schema, state.schema, renames, highest)
        key = _renamed_key(state, shape)
        if df is None:
            stored = {f.metadata[_ID]: f.dataType for f in state.schema.fields}
            for f in shape.fields:
                old = stored.get(f.metadata[_ID], f.dataType)
                if old != f.dataType and (type(old), type(f.dataType)) not in _WIDENINGS:
                    raise ValueError(f"{f.name}: {old.simpleString()} to {f.dataType.simpleString()} needs new contents")
        return TableChange(table_id, state.table, "alter", shape, key, add=df,
                           remove=state.parts if df is not None else [], previous=state.schema)

    def _highest_column_id(self, table_id: int) -> int:
        shapes = self.commits().filter(F.col("table_id") == table_id).select("schema_json").distinct()
        return max((f.metadata[_ID] for r in shapes.collect() for f in shape_of(r["schema_json"]).fields), default=0)

    def renaming(self, table_id: int, name: str) -> TableChange:
        state = self._live(table_id)
        return TableChange(table_id, name, "rename", state.schema, state.key)

    def dropping(self, table_id: int) -> TableChange:
        state = self._live(table_id)
        return TableChange(table_id, state.table, "drop", state.schema, state.key)

    def append(self, table_id: int, df: DataFrame, **how) -> int:
        return self.commit([self.appending(table_id, df)], **how)

    def replace(self, table_id: int, df: DataFrame, parts: list[str] | None = None, **how) -> int:
        return self.commit([self.replacing(table_id, df, parts)], **how)

    def alter(self, table_id: int, schema: T.StructType, renames: dict[str, str] | None = None,
              df: DataFrame | None = None, **how) -> int:
        return self.commit([self.altering(table_id, schema, renames, df)], **how)

    def rename(self, table_id: int, name: str, **how) -> int:
        return self.commit([self.renaming(table_id, name)], **how)

    def drop(self, table_id: int, **how) -> int:
        return self.commit([self.dropping(table_id)], **how)

    def empty_commit(self, **how) -> int:
        return self.commit([], **how)
