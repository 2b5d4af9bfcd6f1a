"""Row changes between two versions of a table."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from rowtide.functions.events import DELETE, INSERT, UPDATE_POST, UPDATE_PRE

ROWID = "rowid"
ROWKEY = "rowkey"  # the key itself, as JSON, where the row id is a hash of it; else empty
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def with_rowid(df: DataFrame, key: list[str], keep: list[str] = (), columns: list[str] | None = None) -> DataFrame:
    """``keep…, rowid, rowkey, row``: the user columns nested in ``row``, so that no user column can be
    mistaken for one of ours. One integral key column is the row id; other keys are hashed, and go along
    as JSON in ``rowkey``: rows are told apart by both, so keys that share a hash stay two rows."""
    columns = columns or [c for c in df.columns if c not in keep]
    single = len(key) == 1 and isinstance(df.schema[key[0]].dataType, INTEGRAL)
    rowid = F.col(f"`{key[0]}`").cast("long") if single else F.xxhash64(*[F.col(f"`{c}`") for c in key])
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in key]), {"ignoreNullFields": "false"})
    rowkey = F.lit("") if single else text
    return df.select(
        *keep, rowid.alias(ROWID), rowkey.alias(ROWKEY), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))


def require_unique(df: DataFrame, by: list[str]) -> DataFrame:
    """Pass rows through and fail the query when two of them share ``by``.

    The check is a count per key over the partitioning and order a merge join on ``by`` needs
    anyway, so it adds no shuffle to the diff.
    """
    counted = df.withColumn("_same", F.count(F.lit(1)).over(W.partitionBy(*by)))
    message = F.concat_ws(" ", F.lit("the key is null or not unique: rowid"), F.col(ROWID).cast("string"))
    sound = (F.col("_same") == 1) & F.col(ROWID).isNotNull()
    return counted.filter(F.assert_true(sound, message).isNull()).drop("_same")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number. Partial counts precede the shuffle."""
    return df.groupBy(*key).count().filter(F.col("count") > 1)


def inserts(new: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Changes of a commit that only adds rows: no join, no shuffle."""
    return new.select(*keep, ROWID, ROWKEY, F.lit(INSERT).alias("change_type"), "row")


def deletes(old: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Changes of a commit that only removes rows."""
    return old.select(*keep, ROWID, ROWKEY, F.lit(DELETE).alias("change_type"), "row")


def snapshot_diff(old: DataFrame, new: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Rows of ``old`` and ``new`` (``keep…, rowid, rowkey, row``) compared by ``keep``, row id and key.

    Gives ``keep…, rowid, rowkey, change_type, row``: an insert, a delete, or the two halves of an update;
    equal rows vanish. Comparison is null-safe, takes NaN as equal to NaN, and maps as equal that have equal entries.
    """
    by = [*keep, ROWID, ROWKEY]
    left = require_unique(old, by).select(*by, F.col("row").alias("_old"))
    right = require_unique(new, by).select(*by, F.col("row").alias("_new"))
    joined = left.join(right, by, "full_outer")
    changes = _changes(old.schema["row"].dataType, new.schema["row"].dataType)
    return joined.select(*by, F.explode(changes).alias("_c")).select(
        *by, F.col("_c.change_type"), F.col("_c.row")
    )


def comparable(value: Column, dtype: T.DataType) -> Column:
    """A value in a form that can be compared: maps, which have no order, as their entries sorted by key, at any
    depth. Other values are taken as they are. Only used to compare; rows keep their own form."""
    if not _has_map(dtype):
        return value
    if isinstance(dtype, T.StructType):
        fields = [comparable(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: comparable(item, dtype.elementType))
    if isinstance(dtype, T.VariantType):
        return F.to_json(value)
    entry = lambda e: F.struct(e.getField("key").alias("key"), comparable(e.getField("value"), dtype.valueType).alias("value"))
    return F.array_sort(F.transform(F.map_entries(value), entry))


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    return isinstance(dtype, (T.MapType, T.VariantType))


def _changes(old: T.DataType, new: T.DataType) -> Column:
    def change(kind: str, side: str) -> Column:
        return F.struct(F.lit(kind).alias("change_type"), F.col(side).alias("row"))

    return (
        F.when(F.col("_old").isNull(), F.array(change(INSERT, "_new")))
        .when(F.col("_new").isNull(), F.array(change(DELETE, "_old")))
        .when(
            ~comparable(F.col("_old"), old).eqNullSafe(comparable(F.col("_new"), new)),
            F.array(change(UPDATE_PRE, "_old"), change(UPDATE_POST, "_new")),
        )
    )


def diff_tables(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``snapshot_diff`` of two plain tables. Columns missing in ``old`` count as NULL there, and
    columns missing in ``new`` are ignored: the old rows are read in the new shape."""
    have = set(old.columns)
    reshaped = old.select(*[
        (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in new.schema.fields
    ])
    return snapshot_diff(with_rowid(reshaped, key), with_rowid(new, key))
