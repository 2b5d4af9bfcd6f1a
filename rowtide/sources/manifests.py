"""Streaming source over a manifest directory: one row per manifest line, in number order.

Offsets are manifest numbers, so a batch that failed is read again with exactly the same range, and
a manifest is never delivered before all earlier ones. The rows are metadata; whoever receives them
reads the data they name with Spark.
"""

import datetime as dt
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType, TimestampType

from rowtide.settings import scratch_dir
from rowtide.sources import files

FORMAT = "rowtide_manifests"
_PER_TASK = 1000


class HistoryRemoved(Exception):
    """Manifests the reader still needs were cleaned up."""


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class ManifestStreamReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options):
        self._fields = [(f.name, isinstance(f.dataType, TimestampType)) for f in schema.fields]
        self._dir = options["path"]
        self._start = int(options.get("startafter", "0"))
        self._last: int | None = None

    def initialOffset(self) -> dict:
        return {"number": self._start}

    def latestOffset(self) -> dict:
        if self._last is None:
            numbers = files.manifest_numbers(self._dir)
            if numbers and numbers[0] > self._start + 1:
                raise HistoryRemoved(f"manifests {self._start + 1} to {numbers[0] - 1} are gone from {self._dir}")
            self._last = self._start
        self._last = files.present_after(self._dir, self._last)
        return {"number": self._last}

    def partitions(self, start: dict, end: dict):
        first, last = start["number"] + 1, end["number"]
        return [_Range(n, min(n + _PER_TASK - 1, last)) for n in range(first, last + 1, _PER_TASK)]

    def read(self, partition):
        for number in range(partition.first, partition.last + 1):
            for row in files.read_json(files.manifest_path(self._dir, number)):
                yield tuple(
                    dt.datetime.fromisoformat(row[n]) if is_time and row.get(n) else row.get(n)
                    for n, is_time in self._fields
                )


class ManifestSource(DataSource):
    """Options: ``path`` (manifest directory), ``startAfter`` (number before the first one read)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        raise ValueError("give the schema with .schema(...)")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ManifestStreamReader(schema, self.options)


def ship_with_jobs() -> None:
    """Send this module's code along with the jobs, so workers need no installed copy of it."""
    for module in (files, sys.modules[__name__]):
        cloudpickle.register_pickle_by_value(module)


def in_steps(batch: DataFrame, number: str, step: int):
    """The rows of a micro-batch of manifests as lists that span ``step`` manifests each, in order: a backlog of
    any length comes to the driver piece by piece. A backlog of several steps is written once, so that
    a manifest is opened twice, however many steps there are, and a step reads the files with its own rows only."""
    ends = batch.agg(F.min(number).alias("low"), F.max(number).alias("high")).first()
    if ends["low"] is None:
        return
    path = scratch_dir(batch.sparkSession, "backlog") if ends["high"] - ends["low"] >= step else None
    try:
        if path:
            batch.write.parquet(path)  # the source's partitions are runs of manifests, so are these files
            batch = batch.sparkSession.read.schema(batch.schema).parquet(path)
        for low in range(ends["low"], ends["high"] + 1, step):
            rows = batch.filter(F.col(number).between(low, low + step - 1)).collect()
            if rows:
                yield sorted(rows, key=lambda r: r[number])
    finally:
        if path:
            files.delete(path)


def manifest_stream(spark: SparkSession, path: str, schema: StructType, start_after: int):
    ship_with_jobs()
    spark.dataSource.register(ManifestSource)
    return (
        spark.readStream.format(FORMAT).schema(schema)
        .option("path", path).option("startAfter", str(start_after)).load()
    )
