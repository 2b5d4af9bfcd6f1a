"""Order: numbering rows without a gap, and looking back or ahead along an order.

A window over a whole table, or over one busy key, would run in one task. The functions here cut
the order into pieces, work on every piece in parallel, and carry a small summary per piece.
"""

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rowtide.functions.events import CHANGE, TABLE_DROPPED, UPDATE_POST
from rowtide.settings import local_table, tracked_dir

# Rows of one key that share a piece at most, when the order column has no repeated value.
CELL_WIDTH = 65_536
PIECE_BITS = 16  # rows of one partition that are numbered together, as a power of two

_POSITION_BITS = 33  # monotonically_increasing_id: partition number above, position below

_GROUP = ["snapshot_id", "_rank", "table_id"]
_INSIDE = ["rowid", "_image"]
EVENT_ORDER = [*_GROUP, *_INSIDE]


def _staged(sorted_rows: DataFrame, stage: str | None) -> DataFrame:
    """Write rows once with the partition (``_part``) and place (``_place``) they have there.

    From then on both are plain columns, which a lost and repeated task cannot change."""
    stage = stage or tracked_dir(sorted_rows.sparkSession, "sequence")
    placed = sorted_rows.withColumn("_place", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_place", _POSITION_BITS).cast("long"))
    placed.write.mode("overwrite").parquet(stage)
    return sorted_rows.sparkSession.read.schema(placed.schema).parquet(stage)


def number_rows(
    df: DataFrame, order: list[str], out: str = "seq", base: int = 0, stage: str | None = None,
    weight: str | None = None,
) -> tuple[DataFrame, int]:
    """Number rows ``base+1, base+2, …`` in the total order ``order``; give them and their count.

    A range sort spreads the rows over all tasks, also those of one snapshot or table; ``order``
    should tell all rows apart. With ``weight`` a row stands for that many rows and gets the
    number of the last of them. Only one sum per partition is gathered, to place the partitions.
    """
    spark = df.sparkSession
    staged = _staged(df.repartitionByRange(*order).sortWithinPartitions(*order), stage)
    size = F.sum(weight) if weight else F.count(F.lit(1))
    sums = sorted((r["_part"], r["n"]) for r in staged.groupBy("_part").agg(size.alias("n")).collect())
    ends = list(accumulate((n for _, n in sums), initial=base))
    starts = local_table(spark, [(p, start) for (p, _), start in zip(sums, ends)], "_part long, _start long")
    if weight:
        inside = F.sum(weight).over(W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, 0))
    else:
        inside = F.col("_place") - F.shiftleft("_part", _POSITION_BITS) + 1
    numbered = staged.withColumn("_inside", inside).join(F.broadcast(starts), "_part")  # one row per partition
    numbered = numbered.withColumn(out, (F.col("_start") + F.col("_inside")).cast("long"))
    return numbered.select(out, *[c for c in df.columns if c != out]), ends[-1] - base


def number_groups(
    df: DataFrame, groups: list[str], inside: list[str], out: str = "seq", base: int = 0, stage: str | None = None,
    piece_bits: int = PIECE_BITS,
) -> tuple[DataFrame, int]:
    """Number rows ``base+1, base+2, …`` with the ``groups`` in order; give them and their count.

    Rows are written as they come, and dealt in pieces of ``2 ** piece_bits`` rows of a partition, so neither
    a group nor a partition of any size is sorted as a whole. Within a group the pieces follow one another,
    each ordered by ``inside``. The counts per group and piece are numbered like rows with a weight, whatever
    their number, and stand before the rows of their piece as one row more.
    """
    staged = _staged(df, stage and f"{stage}/placed").withColumn("_piece", F.shiftright("_place", piece_bits))
    pieces = staged.groupBy(*groups, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    ended, count = number_rows(pieces, [*groups, "_piece"], "_end", base, stage and f"{stage}/pieces", weight="_n")
    starts = ended.select(*groups, "_piece", (F.col("_end") - F.col("_n")).alias("_start"))
    both = staged.withColumn("_start", F.lit(None).cast("long")).unionByName(starts, allowMissingColumns=True)
    # The last group column comes first: a writer with a folder per value of it need not sort again.
    piece = W.partitionBy(*reversed(groups), "_piece").orderBy(F.desc_nulls_last("_start"), *inside, "_place")
    start = F.first("_start", ignorenulls=True).over(piece.rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = both.withColumn("_base", start).withColumn("_number", F.row_number().over(piece) - 1)
    numbered = placed.filter(F.col("_start").isNull()).withColumn(out, F.col("_base") + F.col("_number"))
    return numbered.select(out, *[c for c in df.columns if c != out]), count


def union_log(changes: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """Changes and markers as one set of events with the columns of ``EVENT_ORDER``.

    A schema marker comes before the changes of its snapshot, a drop marker after them.
    """
    events = changes if markers is None else changes.unionByName(markers, allowMissingColumns=True)
    rank = F.when(F.col("type") == CHANGE, 1).when(F.col("type") == TABLE_DROPPED, 2).otherwise(0)
    image = F.when(F.col("change_type") == UPDATE_POST, 1).otherwise(0)
    return events.withColumn("_rank", rank).withColumn("_image", image)


def assign_seq(
    events: DataFrame, base: int = 0, stage: str | None = None, total_order: bool = False
) -> tuple[DataFrame, int]:
    """Give the events of ``union_log`` the next numbers of the log: snapshots ascending, markers
    in their place, tables ascending. Within one commit to one table the order is free, so rows are
    sorted in pieces only; ``total_order`` sorts by row id there too."""
    if total_order:
        numbered, count = number_rows(events, EVENT_ORDER, "seq", base, stage)
    else:
        numbered, count = number_groups(events, _GROUP, _INSIDE, "seq", base, stage)
    return numbered.drop("_rank", "_image"), count


def _cells(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_cell", F.floor(F.col(order) / F.lit(width)).cast("long"))


def look_along(
    df: DataFrame, keys: list[str], order: str, values: dict[str, Column], ahead: bool = False,
    width: int = CELL_WIDTH,
) -> DataFrame:
    """Add, per name in ``values``, its last non-null value strictly before the row within
    ``keys`` (or the first one after it, with ``ahead``). ``order`` is unique within ``keys``."""
    for name, value in values.items():
        df = df.withColumn(f"_v_{name}", value)
    df = _cells(df, order, width)
    direction = (lambda c: F.col(c).desc()) if ahead else F.col
    pick = F.min_by if ahead else F.max_by
    near = W.partitionBy(*keys, "_cell").orderBy(direction(order)).rowsBetween(W.unboundedPreceding, -1)
    far = W.partitionBy(*keys).orderBy(direction("_cell")).rowsBetween(W.unboundedPreceding, -1)

    def edge(name: str) -> Column:
        return pick(F.struct(f"_v_{name}"), F.when(F.col(f"_v_{name}").isNotNull(), F.col(order))).getField(f"_v_{name}")

    summary = df.groupBy(*keys, "_cell").agg(*[edge(n).alias(f"_e_{n}") for n in values])
    summary = summary.select(
        *keys, "_cell", *[F.last(f"_e_{n}", ignorenulls=True).over(far).alias(f"_f_{n}") for n in values]
    )
    for name in values:
        df = df.withColumn(f"_n_{name}", F.last(f"_v_{name}", ignorenulls=True).over(near))
    joined = df.join(summary, [*keys, "_cell"], "left")
    for name in values:
        joined = joined.withColumn(name, F.coalesce(f"_n_{name}", f"_f_{name}"))
    return joined.drop("_cell", *[f"_{x}_{n}" for n in values for x in "vnf"])


def running_count(
    df: DataFrame, keys: list[str], order: str, flag: Column, out: str, width: int = CELL_WIDTH
) -> DataFrame:
    """Number of rows with ``flag`` up to and including the row, within ``keys``."""
    df = _cells(df.withColumn("_flag", flag.cast("long")), order, width)
    near = W.partitionBy(*keys, "_cell").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    far = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    summary = df.groupBy(*keys, "_cell").agg(F.sum("_flag").alias("_sum"))
    summary = summary.select(*keys, "_cell", F.coalesce(F.sum("_sum").over(far), F.lit(0)).alias("_before"))
    return (
        df.withColumn("_inside", F.sum("_flag").over(near))
        .join(summary, [*keys, "_cell"], "left")
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_cell", "_flag", "_inside", "_before")
    )
