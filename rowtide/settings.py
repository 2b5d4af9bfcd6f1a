"""Where intermediate tables go.

How tables are joined is left to adaptive execution, which sees their sizes when they are there."""

import atexit
import contextlib
import contextvars
import datetime as dt
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    A folder of this machine is made only where that setting is missing and Spark itself runs
    on this machine alone.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="rowtide-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def check_path(spark: SparkSession, path: str) -> str:
    """``path`` without a slash at the end. One without a scheme is refused where Spark would take it for a path
    of another file system than this process does."""
    if "://" not in path and not path.startswith("file:"):
        default = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        if not default.startswith("file:"):
            raise ValueError(f"{path}: give the file system too, as in {default.rstrip('/')}{path}")
    return path.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder, removed when this program ends."""
    root = f"{shared_dir(spark)}/rowtide/{spark.conf.get('spark.app.id', 'local')}-{_RUN}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove, root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


_RUN = uuid.uuid4().hex
_roots: set[str] = set()


def _remove(path: str) -> None:
    from rowtide.sources import files

    files.delete(path)


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """Small DataFrame of values the driver has anyway (manifests, offsets, flags). It is part of
    the plan: reading it starts no job, and an empty one is optimized away."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def column(place: int, kind: pa.DataType) -> pa.Array:
        values = [row[place] for row in rows]
        if pa.types.is_timestamp(kind):
            values = [v.astimezone(dt.timezone.utc) if isinstance(v, dt.datetime) else v for v in values]
        return pa.array(values, type=kind)

    arrays = [column(i, f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=schema)


_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("rowtide_scratch", default=None)


@contextlib.contextmanager
def scratch_scope():
    """Remove the scratch tables made inside, when the work that uses them is done."""
    from rowtide.sources import files

    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            files.delete(path)


def tracked_dir(spark: SparkSession, label: str) -> str:
    """``scratch_dir`` that goes with the current ``scratch_scope``, if there is one."""
    path = scratch_dir(spark, label)
    if _scope.get() is not None:
        _scope.get().append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, for results used more than once.

    Unlike a cache it survives the loss of executors without being computed again.
    """
    path = tracked_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
