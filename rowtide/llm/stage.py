"""Intermediate tables of the operators, and how large the batches handed to Python are."""

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from rowtide.settings import scratch_dir
from rowtide.sources import files

# Bytes of a batch that Spark hands to a Python worker; rows differ in length by orders of magnitude.
BATCH_BYTES = 8 * 1024 * 1024


def bounded_batches(spark: SparkSession, bytes_: int = BATCH_BYTES) -> None:
    """Bound the batches of ``mapInArrow`` by bytes, unless the session already sets a bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(bytes_))


@contextlib.contextmanager
def _switched_on(spark: SparkSession, key: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_removed(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """What is run inside loses its shuffle files as soon as it is done, not when the driver happens to collect its
    garbage. For results that are written: nothing reads those files again."""
    return _switched_on(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled")


def buckets_in_order(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """What is run inside takes a bucket of one file as sorted, as it was written, and does not sort it again."""
    return _switched_on(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder (``spark.checkpoint.dir``) and read it back.

    It cuts the lineage: a lost executor repeats tasks of the job that reads the table, not the work
    before it."""
    path = scratch_dir(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def bucketed(df: DataFrame, label: str, column: str) -> Iterator[DataFrame]:
    """``df`` as a table in buckets of ``column``, which is grouped and joined by it without a shuffle; it is there inside
    only."""
    spark, table = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        with shuffles_removed(spark):
            rows = df.repartition(n, column).write.format("parquet").option("compression", "zstd")
            rows.bucketBy(n, column).sortBy(column).saveAsTable(table)
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def discard(df: DataFrame) -> None:
    """Remove the files of a ``staged`` table that nothing reads any more."""
    for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        files.delete(folder)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"{stem}_{uuid.uuid4().hex[:6]}"
    return name
