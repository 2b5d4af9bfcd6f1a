"""The event shape: envelopes, markers, subjects, ids, and the JSON form of a row."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowtide.schemas import EVENT, ROW_MAP, conform

# The kinds of events and of changes, and the texts a reader of the log is shown for markers.
CHANGE = "change"
SCHEMA_CHANGED = "schema_changed"
TABLE_DROPPED = "table_dropped"

INSERT = "insert"
UPDATE_PRE = "update_preimage"
UPDATE_POST = "update_postimage"
DELETE = "delete"

RESTARTS_HERE = "stream restarts here"
ENDED = "stream ended"


def subject(prefix: str, table_id: Column | str = "table_id") -> Column:
    """Name of the stream of events of a table: the prefix and the table's number."""
    return F.concat_ws(".", F.lit(prefix), F.col(table_id) if isinstance(table_id, str) else table_id)


def message_id(keyed: bool = False) -> Column:
    """What tells an event from all others, and a copy of it from nothing: for a change its table, snapshot,
    row and kind, for a marker its kind, table and snapshot. ``keyed`` takes the key into it where the row
    id is a hash only."""
    row = F.coalesce(F.col("rowid").cast("string"), F.lit(""))
    key = F.nullif("rowkey", F.lit("")) if keyed else F.lit(None)
    return F.when(
        F.col("type") == CHANGE, F.concat_ws("-", "table_id", "snapshot_id", row, key, "change_type")
    ).otherwise(F.concat_ws("-", "type", "table_id", "snapshot_id"))


def change_events(changes: DataFrame, prefix: str) -> DataFrame:
    """Put change rows (``table_id, table, snapshot_id, snapshot_time, rowid, change_type, row``)
    into the event envelope. ``row`` may be a struct, which is encoded here, or JSON already."""
    if isinstance(changes.schema["row"].dataType, T.StructType):
        changes = changes.withColumn("row", encode_row(changes, "row"))
    shaped = changes.withColumn("type", F.lit(CHANGE)).withColumn("subject", subject(prefix))
    return conform(shaped, EVENT).withColumn("message_id", message_id(keyed=True))


def marker_events(markers: DataFrame, prefix: str) -> DataFrame:
    """Markers (``type, table_id, table, snapshot_id[, columns, schema_json, retyped]``) as events. What
    describes a new shape is left out of all others."""
    reshaped = F.col("type") == SCHEMA_CHANGED
    for name in ("columns", "schema_json", "retyped"):
        if name in markers.columns:
            markers = markers.withColumn(name, F.when(reshaped, F.col(name)))
    shaped = markers.withColumn("subject", subject(prefix))
    return conform(shaped, EVENT).withColumn("message_id", message_id(keyed=True))


# --- JSON form of a row ---


def _plain(value: Column, dtype: T.DataType) -> Column:
    """A value whose JSON form is the one readers of the log expect: numbers, booleans, strings
    and null as they are; decimals, dates and times as text; nested values likewise inside."""
    if isinstance(dtype, T.TimestampNTZType):
        return _timestamp_text(value)
    if isinstance(dtype, T.TimestampType):
        return F.concat(_timestamp_text(value), F.lit("+00:00"))
    if isinstance(dtype, (T.StringType, T.BooleanType, T.BinaryType)):
        return value
    if isinstance(dtype, T.NumericType) and not isinstance(dtype, T.DecimalType):
        return value
    if isinstance(dtype, T.StructType):
        fields = [_plain(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: _plain(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, item: _plain(item, dtype.valueType))
    return value.cast("string")


def _timestamp_text(value: Column) -> Column:
    whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    return F.when(value == F.date_trunc("second", value), whole).otherwise(
        F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )


def encode_row(df: DataFrame, column: str) -> Column:
    """JSON object of a struct column, nulls kept."""
    struct = df.schema[column].dataType
    fields = [_plain(F.col(f"{column}.`{f.name}`"), f.dataType).alias(f.name) for f in struct.fields]
    return F.when(
        F.col(column).isNotNull(), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    )


def decode_row(row: Column | str) -> Column:
    """JSON object → name → text of the value (NULL for JSON null)."""
    return F.from_json(row, ROW_MAP)


def decode_typed(row: Column | str, schema: T.StructType) -> Column:
    """JSON object → struct of the epoch's own types."""
    return F.from_json(row, schema, {"mode": "FAILFAST"})


def json_values(row: Column | str) -> Column:
    """JSON object → name → JSON text of the value, so that 1 and "1" stay apart."""
    return F.transform_values(F.from_json(row, "map<string,variant>"), lambda _, v: F.to_json(v))


# --- readable text ---


def _quoted(text: Column) -> Column:
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def shown(value: Column) -> Column:
    """One JSON value (as JSON text) as a reader prints it: strings quoted, None, True, False."""
    return (
        F.when(value.isNull() | (value == "null"), "None")
        .when(value == "true", "True")
        .when(value == "false", "False")
        .when(value.startswith('"'), _quoted(F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")),
                                                         "v string").getField("v")))
        .otherwise(value)
    )


def row_detail(row: Column | str) -> Column:
    """``name=value`` pairs of a row, joined by commas."""
    pairs = F.transform(
        F.map_entries(json_values(row)),
        lambda e: F.concat_ws("=", e.getField("key"), shown(e.getField("value"))),
    )
    return F.concat_ws(", ", pairs)


def describe(events: DataFrame) -> DataFrame:
    """Every event as ``seq, subject, kind, snapshot, table, detail`` for people to read."""
    kind = (
        F.when(F.col("type") == SCHEMA_CHANGED, "SCHEMA CHANGE")
        .when(F.col("type") == TABLE_DROPPED, "TABLE DROPPED")
        .otherwise(F.col("change_type"))
    )
    detail = (
        F.when(F.col("type") == SCHEMA_CHANGED, RESTARTS_HERE)
        .when(F.col("type") == TABLE_DROPPED, ENDED)
        .otherwise(row_detail("row"))
    )
    return events.select(
        "seq", "subject", kind.alias("kind"), F.col("snapshot_id").cast("string").alias("snapshot"),
        F.coalesce("table", F.lit("?")).alias("table"), detail.alias("detail"),
    )


def render_line() -> Column:
    """One line per event, the kind padded to 16 characters."""
    return F.when(
        F.col("type") == CHANGE,
        F.concat(
            F.rpad(F.col("change_type"), 16, " "), F.lit(" snapshot "), F.col("snapshot_id").cast("string"),
            F.lit("  "), F.col("row"),
        ),
    ).otherwise(F.concat(F.upper("type"), F.lit(" at snapshot "), F.col("snapshot_id").cast("string")))


def clock_text(time: Column | str) -> Column:
    return F.date_format(time, "HH:mm:ss")


def iso_text(time: Column | str) -> Column:
    """ISO 8601 text, with microseconds only where there are any."""
    return F.replace(_timestamp_text(F.col(time) if isinstance(time, str) else time), F.lit(" "), F.lit("T"))


def successor_name(base: Column | str, boundary: Column | str) -> Column:
    """Name of the reader that goes on at a boundary."""
    return F.concat_ws("_", base, boundary)


def quoted_name(name: Column | str) -> Column:
    """Qualified name with every part quoted for SQL."""
    parts = F.split(name, r"\.")
    return F.concat_ws(".", F.transform(parts, lambda p: F.concat(F.lit("`"), F.replace(p, F.lit("`"), F.lit("``")), F.lit("`"))))
