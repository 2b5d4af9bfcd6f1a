"""A table rebuilt from its log: the latest row per row id, carried over changes of shape."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowtide.functions.events import (
    CHANGE, DELETE, SCHEMA_CHANGED, TABLE_DROPPED, UPDATE_PRE, decode_row,
)
from rowtide.operators.dedup import first_copies
from rowtide.operators.sequence import look_along
from rowtide.schemas import VIEW, VIEW_META, conform, with_rowkey
from rowtide.settings import local_table, written

_NAMES = "array<string>"


def _no_names() -> Column:
    return F.array().cast(_NAMES)


def drop_points(events: DataFrame) -> DataFrame:
    """Per dropped table the place of its first drop marker."""
    return events.filter(F.col("type") == TABLE_DROPPED).groupBy("table_id").agg(F.min("seq").alias("ended_seq"))


def stop_at_drop(events: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Cut every table's events after its drop marker."""
    points = drop_points(events) if points is None else points
    joined = events.join(points, "table_id", "left")
    return joined.filter(F.col("ended_seq").isNull() | (F.col("seq") <= F.col("ended_seq"))).drop("ended_seq")


def first_shapes(events: DataFrame) -> DataFrame:
    """Columns of the first change event of every table, whatever its kind: ``table_id,
    shape_seq, shape``.

    One event per table and task is kept before the shuffle."""
    shape = F.coalesce(F.expr("json_object_keys(row)"), _no_names())
    first = F.min_by(F.struct(F.col("seq"), F.col("row")), F.col("seq"))
    changes = events.filter(F.col("type") == CHANGE).groupBy("table_id").agg(first.alias("f"))
    return changes.select("table_id", F.col("f.seq").alias("shape_seq"), F.col("f.row").alias("row")).select(
        "table_id", "shape_seq", shape.alias("shape"))


def marker_delta(markers: DataFrame, shapes: DataFrame | None, saved: DataFrame | None = None) -> DataFrame:
    """What every schema marker removes and adds: ``table_id, seq, columns, known, removed, added,
    skip, reload``.

    The columns known before a marker are those of the last marker that named any, else the saved
    ones, else those of the first change event if it came before the marker. A marker without
    columns, and one that removes and adds at once (a rename), is skipped: it only asks for a
    reload. So does a type change.
    """
    schema_markers = markers.filter(F.col("type") == SCHEMA_CHANGED).select(
        "table_id", "seq", "columns",
        *([F.col("retyped")] if "retyped" in markers.columns else [F.lit(None).cast(_NAMES).alias("retyped")]),
    )
    looked = look_along(schema_markers, ["table_id"], "seq", {"_last": F.col("columns")})
    looked = looked.join(shapes, "table_id", "left") if shapes is not None else looked.withColumn(
        "shape", F.lit(None).cast(_NAMES)).withColumn("shape_seq", F.lit(None).cast("long"))
    if saved is not None:
        old = saved.select("table_id", F.col("columns").alias("_saved"))
        looked = looked.join(old, "table_id", "left")
    else:
        looked = looked.withColumn("_saved", F.lit(None).cast(_NAMES))
    earlier_shape = F.when(F.col("shape_seq") < F.col("seq"), F.col("shape"))
    saved_names = F.when(F.size("_saved") > 0, F.col("_saved"))
    known = F.coalesce("_last", saved_names, earlier_shape, _no_names())
    delta = looked.select("table_id", "seq", "columns", "retyped", known.alias("known"))
    delta = delta.withColumn("removed", F.array_except("known", "columns")).withColumn(
        "added", F.array_except("columns", "known")
    )
    renamed = (F.size("known") > 0) & (F.size("removed") > 0) & (F.size("added") > 0)
    skip = F.col("columns").isNull() | renamed
    retyped = F.coalesce(F.size("retyped") > 0, F.lit(False))
    return delta.withColumn("skip", skip).withColumn("reload", skip | retyped).drop("retyped")


def touched_columns(deltas: DataFrame) -> DataFrame:
    """Per table, for every column name that markers removed or added, the last marker that
    removed it, the last that touched it, and whether that one added it.

    That is all a stored row needs: a column removed after the row was written is gone, and one
    added last, after the row was written, is there as NULL. So a row needs no list of markers, and
    the result is as small as the set of column names.
    """
    names = deltas.filter(~F.col("skip")).select(
        "table_id", "seq",
        F.explode(F.concat(
            F.transform("removed", lambda n: F.struct(n.alias("name"), F.lit(False).alias("is_add"))),
            F.transform("added", lambda n: F.struct(n.alias("name"), F.lit(True).alias("is_add"))),
        )).alias("t"),
    )
    per_name = names.groupBy("table_id", "t.name").agg(
        F.max(F.when(~F.col("t.is_add"), F.col("seq"))).alias("removed_at"),
        F.max("seq").alias("touched_at"),
        F.max_by("t.is_add", "seq").alias("is_added"),
    )
    # One entry per column name of the table, never one per row or marker.
    return per_name.groupBy("table_id").agg(
        F.sort_array(F.collect_list(F.struct("name", "removed_at", "touched_at", "is_added"))).alias("touched")
    )


def reshape(rows: DataFrame, touched: DataFrame, row: str = "row", place: str = "seq") -> DataFrame:
    """Bring stored rows (``table_id, row, seq``) to the shape after all markers."""
    joined = rows.join(touched, "table_id", "left")
    gone = F.transform(
        F.filter("touched", lambda t: t.getField("removed_at") > F.col(place)), lambda t: t.getField("name")
    )
    kept = F.map_filter(row, lambda name, _: ~F.array_contains(gone, name))
    wanted = F.transform(
        F.filter("touched", lambda t: t.getField("is_added") & (t.getField("touched_at") > F.col(place))),
        lambda t: t.getField("name"),
    )
    new = F.array_except(wanted, F.map_keys(kept))
    empty = F.map_from_arrays(new, F.transform(new, lambda _: F.lit(None).cast("string")))
    shaped = F.when(F.col("touched").isNull(), F.col(row)).otherwise(F.map_concat(kept, empty))
    return joined.withColumn(row, shaped).drop("touched")


def last_changes(events: DataFrame) -> DataFrame:
    """The last event per row that is not a pre-image: ``table_id, rowid, rowkey, change_type, row,
    seq``. Reduced before the shuffle, so a row changed very often costs one task little."""
    effective = events.filter((F.col("type") == CHANGE) & (F.col("change_type") != UPDATE_PRE))
    last = F.max_by(F.struct("change_type", "row", "seq"), F.col("seq"))
    return with_rowkey(effective).groupBy("table_id", "rowid", "rowkey").agg(last.alias("e")).select(
        "table_id", "rowid", "rowkey", "e.*")


def fold(events: DataFrame) -> DataFrame:
    """Rows present after the events, payload still JSON: ``table_id, rowid, rowkey, row, seq``."""
    return last_changes(events).filter(F.col("change_type") != DELETE).drop("change_type")


class Digest:
    """What events do to tables: ``last``, the last change per row that is no pre-image, with its payload as a map;
    ``touched``, what their markers do to columns (None where there is no marker); and the metadata after them,
    computed when asked for."""

    def __init__(self, last: DataFrame, touched: DataFrame | None, meta):
        self.last, self.touched, self._meta = last, touched, meta

    @property
    def meta(self) -> DataFrame:
        if callable(self._meta):
            self._meta = self._meta()
        return self._meta


class Materialized:
    """View and metadata after a set of events. The metadata are computed when asked for."""

    def __init__(self, rows: DataFrame, digest: Digest):
        self.rows, self._digest = rows, digest

    @property
    def meta(self) -> DataFrame:
        return self._digest.meta


def digest(
    events: DataFrame, saved_meta: DataFrame | None = None, distinct: bool = False, markers_expected: bool = True,
    markers: DataFrame | None = None,
) -> Digest:
    """Reduce events to what a view needs of them; the view itself is not looked at.

    ``distinct`` says that no message id occurs twice, which holds for logs this package wrote; for
    other logs copies are removed first, so that an old event delivered again late cannot move the
    view back. Events after a drop count for nothing; the table is marked ended.
    A caller that knows the events to hold no marker says so with ``markers_expected``; one that
    passes ``saved_meta`` passes a row for every table the events are about. ``markers`` are those of the events,
    where the caller has them apart.
    """
    points = touched = shapes = deltas = None
    if saved_meta is not None:  # a table that ended earlier takes no more events
        over = saved_meta.filter("ended").select("table_id", F.col("last_seq").alias("ended_seq"))
        points = None if over.isEmpty() else over
    if markers_expected:
        optional = [c for c in ("message_id", "schema_json", "retyped") if c in events.columns]
        markers = events.filter(F.col("type") != CHANGE) if markers is None else markers
        markers = markers.select("table_id", "seq", "type", "columns", *optional)
        markers = written(markers if distinct else first_copies(markers), "markers")
        seen = markers.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == TABLE_DROPPED).alias("drops")).first()
        markers = markers if seen["n"] else None
        if seen["drops"]:
            found = drop_points(markers)
            points = found if points is None else points.unionByName(found).groupBy("table_id").agg(
                F.min("ended_seq").alias("ended_seq"))
    if points is not None:
        points = written(points, "drops")
        markers = None if markers is None else stop_at_drop(markers, points)
    live = events if points is None else stop_at_drop(events, points)
    if markers is not None:
        shapes = written(first_shapes(live), "shapes") if _shape_needed(saved_meta) else None
        deltas = marker_delta(markers, shapes, saved_meta)
        touched = written(touched_columns(deltas), "touched")

    # Only this branch carries payloads, so only here copies are removed: the place of the first
    # copy is the least one in any case.
    last = last_changes(live if distinct else first_copies(live)).select(
        "table_id", "rowid", "rowkey", "change_type", decode_row("row").alias("row"), "seq"
    )

    def meta() -> DataFrame:
        known = shapes
        if markers is None and _shape_needed(saved_meta):
            known = first_shapes(live)
        return view_meta(live, markers, known, deltas, points, saved_meta)

    return Digest(last, touched, meta)


def materialize(
    events: DataFrame,
    saved_rows: DataFrame | None = None,
    saved_meta: DataFrame | None = None,
    distinct: bool = False,
    markers_expected: bool = True,
) -> Materialized:
    """Apply events to a saved view (or to none); see ``digest``. After a drop the rows stay."""
    found = digest(events, saved_meta, distinct, markers_expected)
    rows = found.last
    if saved_rows is not None:
        old = with_rowkey(saved_rows).select(
            "table_id", "rowid", "rowkey", F.col("row").alias("_row"), F.col("seq").alias("_seq"))
        both = old.join(rows, ["table_id", "rowid", "rowkey"], "full_outer")
        untouched = F.col("change_type").isNull()
        rows = both.select(
            "table_id", "rowid", "rowkey", "change_type",
            F.when(untouched, F.col("_row")).otherwise(F.col("row")).alias("row"),
            F.when(untouched, F.col("_seq")).otherwise(F.col("seq")).alias("seq"),
        )
    rows = rows.filter(F.col("change_type").isNull() | (F.col("change_type") != DELETE)).drop("change_type")
    if found.touched is not None:
        rows = reshape(rows, found.touched)
    return Materialized(conform(rows, VIEW), found)


def merge_touched(saved: list[dict], new: list) -> list[dict]:
    """``touched`` entries of one table after more markers: per column name the last removal and the last touch.
    Reshaping a row by the merged list gives what reshaping it by one list after the other gives."""
    names = {t["name"]: dict(t) for t in saved}
    for t in new:
        old = names.get(t["name"], {})
        removed = t["removed_at"] if t["removed_at"] is not None else old.get("removed_at")
        names[t["name"]] = {"name": t["name"], "removed_at": removed, "touched_at": t["touched_at"], "is_added": t["is_added"]}
    return sorted(names.values(), key=lambda t: t["name"])


def _shape_needed(saved_meta: DataFrame | None) -> bool:
    """Only tables without known columns need those of their first event: always so, unless the
    caller follows the one table it saved."""
    if saved_meta is None:
        return True
    known = saved_meta.agg(F.min(F.coalesce(F.size("columns"), F.lit(0))).alias("c")).first()["c"]
    return not known


def view_meta(
    events: DataFrame, markers: DataFrame, shapes: DataFrame | None, deltas: DataFrame | None,
    points: DataFrame | None, saved: DataFrame | None = None,
) -> DataFrame:
    """``table_id, last_seq, columns, schema_json, needs_reload, ended`` per table."""
    places = events.groupBy("table_id").agg(F.max("seq").alias("_last"))
    joined = places.join(saved if saved is not None else _no_meta(events), "table_id", "full_outer")
    none = F.lit(None)
    sides = {"_columns": none.cast(_NAMES), "_schema": none.cast("string"), "shape": none.cast(_NAMES),
             "_reload": none.cast("boolean"), "ended_seq": none.cast("long")}
    found = []
    if deltas is not None:
        named = F.when(F.col("columns").isNotNull(), F.col("seq"))
        schema = F.col("schema_json") if "schema_json" in markers.columns else none.cast("string")
        found.append(markers.filter(F.col("type") == SCHEMA_CHANGED).groupBy("table_id").agg(
            F.max_by("columns", named).alias("_columns"), F.max_by(schema, named).alias("_schema")))
        found.append(deltas.groupBy("table_id").agg(F.bool_or("reload").alias("_reload")))
    if shapes is not None:
        found.append(shapes.select("table_id", "shape"))
    if points is not None:
        found.append(points)
    for side in found:
        joined = joined.join(side, "table_id", "left")
    for name, empty in sides.items():
        if name not in joined.columns:
            joined = joined.withColumn(name, empty)
    known = F.when(F.size("columns") > 0, F.col("columns"))
    return conform(joined.select(
        "table_id",
        F.greatest("_last", "last_seq").alias("last_seq"),
        F.coalesce("_columns", known, "shape", _no_names()).alias("columns"),
        F.coalesce("_schema", "schema_json").alias("schema_json"),
        (F.coalesce("_reload", F.lit(False)) | F.coalesce("needs_reload", F.lit(False))).alias("needs_reload"),
        (F.col("ended_seq").isNotNull() | F.coalesce("ended", F.lit(False))).alias("ended"),
    ), VIEW_META)


def _no_meta(like: DataFrame) -> DataFrame:
    return local_table(like.sparkSession, [], VIEW_META)


def in_order(rows: DataFrame) -> DataFrame:
    """View rows by row id as a number, not as text."""
    return rows.orderBy("table_id", F.col("rowid").cast("long"), "rowkey")


def typed_view(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """View rows as plain columns of the given types."""

    def typed(field: T.StructField) -> Column:
        value = F.col("row")[field.name]
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return _with_keys(F.from_json(value, _text_keys(field.dataType)), field.dataType)
        if isinstance(field.dataType, T.BinaryType):
            return F.unbase64(value)
        return value.cast(field.dataType)

    return rows.select("rowid", *[typed(f).alias(f.name) for f in schema.fields])


def _text_keys(dtype: T.DataType) -> T.DataType:
    """The type as JSON holds it: maps have texts as keys."""
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _text_keys(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_text_keys(dtype.elementType))
    return T.MapType(T.StringType(), _text_keys(dtype.valueType)) if isinstance(dtype, T.MapType) else dtype


def _with_keys(value: Column, dtype: T.DataType) -> Column:
    """A value read with ``_text_keys`` in its own type."""
    if _text_keys(dtype).simpleString() == dtype.simpleString():
        return value
    if isinstance(dtype, T.StructType):
        fields = [_with_keys(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: _with_keys(item, dtype.elementType))
    entry = lambda e: F.struct(e.getField("key").cast(dtype.keyType).alias("key"), _with_keys(e.getField("value"), dtype.valueType).alias("value"))
    return F.map_from_entries(F.transform(F.map_entries(value), entry))


def last_table_name(events: DataFrame) -> DataFrame:
    """Latest name seen that is not empty, per table id."""
    named = F.when(F.col("table") != "", F.col("seq"))
    return events.groupBy("table_id").agg(F.max_by("table", named).alias("table"))


def header_columns(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Column heads of the view per table: known columns, then other names found in rows.

    The names in rows are made distinct before they are gathered: one entry per column name."""
    extra = rows.select("table_id", F.explode(F.map_keys("row")).alias("name")).distinct()
    names = extra.groupBy("table_id").agg(F.sort_array(F.collect_list("name")).alias("_names"))
    return meta.join(names, "table_id", "left").select(
        "table_id", F.array_union("columns", F.coalesce("_names", _no_names())).alias("header")
    )


def empty_view(spark) -> DataFrame:
    return local_table(spark, [], VIEW)
