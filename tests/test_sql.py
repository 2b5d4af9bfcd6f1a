from rowtide.sources.lake import Lake
from rowtide.sources.log import EventLog
from rowtide.sources.sql import register_views, run_sql
from rowtide.streaming.capture import Capture


def test_statements_over_lake_and_log(spark, folder):
    lake, log = Lake(spark, f"{folder}/lake"), EventLog(spark, f"{folder}/log").create(0)
    lake.create("db.people", spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), ["id"])
    Capture(lake, log).publish_commits(lake.commits().collect())
    assert set(register_views(spark, lake, log)) == {"commits", "epochs", "db.people", "batches", "log"}
    found = run_sql(spark, "SELECT max(v) FROM `db.people`", "SELECT count(*) FROM log", "SELECT epoch FROM epochs")
    assert [df.first()[0] for df in found] == ["b", 2, 1]
