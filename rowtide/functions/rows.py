"""Expressions over rows held as name → value maps."""

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.functions.events import json_values, shown

MISSING = "∅"


def diff_fields(updates: DataFrame, keep: list[str]) -> DataFrame:
    """One row per changed column of an update: ``field, from_value, to_value``.

    ``before`` and ``after`` are JSON rows. A column absent on one side shows as ∅. An update in
    which nothing differs gives one row with ``field`` NULL and ``note`` set.
    """
    sides = updates.select(
        *keep, json_values("before").alias("_b"), json_values("after").alias("_a")
    ).select(
        *keep,
        F.coalesce("_b", F.create_map().cast("map<string,string>")).alias("_b"),
        F.coalesce("_a", F.create_map().cast("map<string,string>")).alias("_a"),
    )
    names = F.array_union(F.map_keys("_b"), F.map_keys("_a"))
    changed = F.filter(names, lambda k: ~F.col("_b")[k].eqNullSafe(F.col("_a")[k]))

    def side(column: str) -> Column:
        value = F.col(column)[F.col("field")]
        return F.when(F.col("field").isNull(), None).when(
            F.map_contains_key(column, F.coalesce("field", F.lit(""))), shown(value)
        ).otherwise(MISSING)

    return (
        sides.withColumn("field", F.explode_outer(changed))
        .select(
            *keep, "field", side("_b").alias("from_value"), side("_a").alias("to_value"),
            F.when(F.col("field").isNull(), "no value changed").alias("note"),
        )
    )


def header(columns: Column, keys: Column) -> Column:
    """Known columns first, then any other name found in rows."""
    return F.array_union(F.coalesce(columns, F.array().cast("array<string>")), keys)


def value_text(value: Column | str) -> Column:
    """Text of a cell: empty for NULL or a missing column."""
    return F.coalesce(value, F.lit(""))


def contains(map_column: Column | str, key: str, item: Column) -> Column:
    """Is ``item`` in the list stored under ``key``? An absent list counts as empty."""
    entry = (F.col(map_column) if isinstance(map_column, str) else map_column)[key]
    return F.array_contains(F.coalesce(entry, F.array().cast("array<string>")), item)
