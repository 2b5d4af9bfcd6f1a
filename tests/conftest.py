import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("rowtide-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


@pytest.fixture
def never_broadcast(spark):
    """Joins as on tables too large to broadcast."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


EVENT_DDL = (
    "seq long, type string, table_id long, table string, snapshot_id long, rowid long, change_type string, "
    "row string, columns array<string>, schema_json string, retyped array<string>"
)


@pytest.fixture(scope="session")
def log_of(spark):
    """Log rows from short tuples: (kind, rowid, row[, snapshot]) for changes, (marker, columns)."""
    from pyspark.sql import functions as F

    from rowtide.functions.events import message_id, subject

    def make(events, table_id=1, name="orders", first=1):
        rows = []
        for seq, e in enumerate(events, first):
            if e[0] in ("schema_changed", "table_dropped"):
                columns = e[1] if len(e) > 1 else None
                retyped = e[2] if len(e) > 2 else None
                rows.append((seq, e[0], table_id, name, seq, None, None, None, columns, None, retyped))
            else:
                snapshot = e[3] if len(e) > 3 else 1
                rows.append((seq, "change", table_id, name, snapshot, e[1], e[0], e[2], None, None, None))
        frame = spark.createDataFrame(rows, EVENT_DDL)
        return frame.withColumn("subject", subject("changes")).withColumn("message_id", message_id()).withColumn(
            "snapshot_time", F.lit("2026-01-01 00:00:00").cast("timestamp"))

    return make
