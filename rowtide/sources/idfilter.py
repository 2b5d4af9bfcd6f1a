"""Which batches of a log may hold an id: a Bloom filter per batch, kept beside it as bitmaps.

    <ids>/index/<n>.json                              batches that have a filter, its size, and the build that made it
    <ids>/data/build=<x>/batch=<token>/*.parquet      bitmaps of 32,768 bits: shards, bucket, bits

A filter of ``shards`` bitmaps (a power of two) has about ten bits per id, and an id sets ``HASHES`` of them, all in one
bitmap, so that looking an id up takes one row and no grouping by id. One id in seventy is found in a batch that does not
hold it. Ids are dealt by filter and bitmap, so no batch passes through one task. A batch never changes, nor does its
filter. Filters are made when they are first asked for, so a log whose writer knows its ids to be new has none.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowtide.settings import local_table, written
from rowtide.sources import files

HASHES = 3
BITS_PER_ID = 10
_BITS = 32_768  # of one bitmap, as Spark's bitmap functions make them
_NAMED = 1_000
_INDEX = "batch string, shards long, build string"
_DATA = "shards long, bucket long, bits binary, build string, batch string"


def shards_for(rows: int) -> int:
    """Bitmaps for so many ids."""
    return 1 << max(0, -(-rows * BITS_PER_ID // _BITS) - 1).bit_length()


def places(id_: str, shards: Column) -> Column:
    """Where an id sets bits in a filter: one number per hash, from 1, all within one bitmap."""
    bitmap = F.pmod(F.xxhash64(id_, F.lit(HASHES)), shards)
    return F.array(*[bitmap * _BITS + F.pmod(F.xxhash64(id_, F.lit(i)), F.lit(_BITS)) + 1 for i in range(HASHES)])


def _bitmap_and_bits(place: Column) -> list[Column]:
    bits = [F.bitmap_bit_position(place[i]).alias(f"bit{i}") for i in range(HASHES)]
    return [F.bitmap_bucket_number(place[0]).alias("bucket"), *bits]


class IdFilters:
    def __init__(self, spark: SparkSession, path: str):
        # Filters of an earlier form, with an id's bits in several bitmaps, lay in the folder above: they are not read.
        self.spark, self.path = spark, f"{path}/one-bitmap"

    def index(self) -> DataFrame:
        files.make_dir(f"{self.path}/index")
        return self.spark.read.schema(_INDEX).json(f"{self.path}/index")

    def build(self, batches: DataFrame, ids: DataFrame) -> None:
        """Make the filters that some batches (``batch, rows``) lack, from ``ids`` (``batch, message_id``)."""
        missing = batches.join(self.index(), "batch", "left_anti").collect()  # each is a batch not asked about before
        if not missing:
            return
        sizes = [(r["batch"], shards_for(r["rows"])) for r in missing]
        if len(sizes) <= _NAMED:  # so few are named, and no other batch is opened; else most of them are read anyway
            ids = ids.filter(F.col("batch").isin([b for b, _ in sizes]))
        build = uuid.uuid4().hex
        self._bitmaps(ids, sizes).write.partitionBy("batch").parquet(f"{self.path}/data/build={build}")
        numbers = files.manifest_numbers(f"{self.path}/index")
        rows = [{"batch": b, "shards": n, "build": build} for b, n in sizes]
        files.write_json(files.manifest_path(f"{self.path}/index", (numbers[-1] if numbers else 0) + 1), rows, True)

    def _bitmaps(self, ids: DataFrame, sizes: list[tuple[str, int]]) -> DataFrame:
        """``batch, shards, bucket, bits`` of the filters for some batches."""
        named = [(b, n, i) for i, (b, n) in enumerate(sizes)]
        filters = F.broadcast(local_table(self.spark, named, "batch string, shards long, filter int"))  # the driver has them anyway
        placed = ids.join(filters, "batch").select("filter", *_bitmap_and_bits(places("message_id", F.col("shards"))))
        bits = placed.repartition("filter", "bucket").select(
            "filter", "bucket", F.explode(F.array(*[f"bit{i}" for i in range(HASHES)])).alias("bit"))
        made = bits.groupBy("filter", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        return made.join(filters, "filter").select("batch", "shards", "bucket", "bits")

    def holding(self, ids: DataFrame, batches: DataFrame) -> DataFrame:
        """``batch`` of those batches, among the ones with a filter, that may hold one of the ids (``message_id``). No
        event file is opened."""
        asked = self.index().join(batches.select("batch"), "batch")
        sizes = [r["shards"] for r in asked.select("shards").distinct().collect()]  # powers of two
        if not sizes:
            return self.spark.createDataFrame([], "batch string")
        base = f"{self.path}/data"
        stored = self.spark.read.schema(_DATA).option("basePath", base).parquet(base).join(asked.select("batch", "build"), ["batch", "build"])
        each = ids.select("message_id", F.explode(F.array(*[F.lit(n).cast("long") for n in sorted(sizes)])).alias("shards"))
        # Written, so that the join knows how many there are: guessed from the ids' source they would often be broadcast.
        probes = written(each.select("shards", *_bitmap_and_bits(places("message_id", F.col("shards")))), "probes")
        is_set = F.lit(True)
        for i in range(HASHES):
            byte = f"CAST(conv(hex(substring(bits, CAST(bit{i} DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
            is_set = is_set & F.expr(f"(shiftright({byte}, CAST(bit{i} % 8 AS INT)) & 1) = 1")
        hits = probes.join(stored, ["shards", "bucket"]).filter(is_set)
        return written(hits.select("batch").distinct(), "holding")
