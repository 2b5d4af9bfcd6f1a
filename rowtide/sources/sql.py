"""Ad-hoc SQL over a lake and a log."""

from pyspark.sql import DataFrame, SparkSession

from rowtide.operators.epochs import epochs
from rowtide.sources.lake import Lake
from rowtide.sources.log import EventLog


def register_views(spark: SparkSession, lake: Lake | None = None, log: EventLog | None = None) -> list[str]:
    """Make ``commits``, ``epochs``, every live table, ``batches`` and ``log`` known to SQL.

    A table keeps its name, dots included, so ``a.b`` is written `` `a.b` ``. A table called like one of the
    others is refused: neither may stand for the other unnoticed."""
    names = []

    def add(name: str, df: DataFrame) -> None:
        if name.lower() in (n.lower() for n in names):
            raise ValueError(f"two views would be called {name}")
        quoted = name.replace("`", "``")
        df.createOrReplaceTempView(f"`{quoted}`")
        names.append(name)

    if log is not None:
        add("batches", log.batches())
        add("log", log.read())
    if lake is not None:
        commits = lake.commits()
        known = epochs(commits)
        add("commits", commits)
        add("epochs", known)
        for row in known.filter("end_snapshot IS NULL").select("table_id", "table").collect():
            add(row["table"], lake.read_version(row["table_id"]))
    return names


def run_sql(spark: SparkSession, *statements: str) -> list[DataFrame]:
    return [spark.sql(s) for s in statements]
