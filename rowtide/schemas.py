"""Schemas of the tables the package reads and writes.

``commits``  one row per (snapshot, table touched): what a commit did to a table
``log``      one row per event, in ``seq`` order
``batches``  one row per published batch: the only list of batches a reader may trust
"""

from pyspark.sql import types as T

COMMITS = T.StructType([
    T.StructField("snapshot_id", T.LongType()),
    T.StructField("snapshot_time", T.TimestampType()),
    T.StructField("table_id", T.LongType()),
    T.StructField("table", T.StringType()),
    T.StructField("op", T.StringType()),  # create | data | alter | rename | drop | none
    T.StructField("schema_json", T.StringType()),  # full shape after the commit, with column ids
    T.StructField("previous_schema_json", T.StringType()),  # set where the commit changed the shape
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("key", T.ArrayType(T.StringType())),
    T.StructField("parts_added", T.ArrayType(T.StringType())),
    T.StructField("parts_removed", T.ArrayType(T.StringType())),
    T.StructField("changes", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])

BATCHES = T.StructType([
    T.StructField("ordinal", T.LongType()),
    T.StructField("batch_id", T.LongType()),  # greatest snapshot of the batch
    T.StructField("path", T.StringType()),
    T.StructField("start_snapshot", T.LongType()),
    T.StructField("end_snapshot", T.LongType()),
    T.StructField("first_seq", T.LongType()),
    T.StructField("last_seq", T.LongType()),
    T.StructField("rows", T.LongType()),
    T.StructField("marked", T.BooleanType()),  # whether it holds markers, which then are in the side table too
    T.StructField("tables", T.ArrayType(T.LongType())),  # those it has events of
    T.StructField("bytes", T.LongType()),  # of its files
    T.StructField("log_id", T.StringType()),
    T.StructField("published_at", T.TimestampType()),
])

# One event without its place in the log: what producers build.
EVENT = T.StructType([
    T.StructField("subject", T.StringType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("table_id", T.LongType()),
    T.StructField("table", T.StringType()),
    T.StructField("snapshot_id", T.LongType()),  # boundary snapshot on markers
    T.StructField("rowid", T.LongType()),
    T.StructField("rowkey", T.StringType()),  # the key as JSON where the row id is a hash of it; else empty
    T.StructField("change_type", T.StringType()),
    T.StructField("row", T.StringType()),  # JSON object, nulls kept
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("schema_json", T.StringType()),
    T.StructField("retyped", T.ArrayType(T.StringType())),  # columns that kept their name, not their type
    T.StructField("snapshot_time", T.TimestampType()),
])

LOG = T.StructType(
    [T.StructField("seq", T.LongType())]
    + EVENT.fields
    + [T.StructField("published_at", T.TimestampType()), T.StructField("batch_id", T.LongType())]
)

ROW_MAP = T.MapType(T.StringType(), T.StringType())

VIEW = T.StructType([
    T.StructField("table_id", T.LongType()),
    T.StructField("rowid", T.LongType()),
    T.StructField("rowkey", T.StringType()),
    T.StructField("row", ROW_MAP),
    T.StructField("seq", T.LongType()),
])

# What markers did to the columns of a table, one entry per column name ever removed or added.
TOUCHED = "table_id long, touched array<struct<name: string, removed_at: long, touched_at: long, is_added: boolean>>"

VIEW_META = T.StructType([
    T.StructField("table_id", T.LongType()),
    T.StructField("last_seq", T.LongType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("schema_json", T.StringType()),
    T.StructField("needs_reload", T.BooleanType()),
    T.StructField("ended", T.BooleanType()),
])


def with_rowkey(df):
    """``df`` with ``rowkey`` empty where it has none, so that it can be joined and grouped by."""
    from pyspark.sql import functions as F

    return df.withColumn("rowkey", F.coalesce("rowkey", F.lit("")) if "rowkey" in df.columns else F.lit(""))


def conform(df, schema):
    """Select ``schema``'s columns in its order, casting, and NULL where ``df`` has none."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
