from pyspark.sql import functions as F

from rowtide.functions.events import (
    clock_text, describe, iso_text, quoted_name, render_line, row_detail, shown, successor_name,
)
from rowtide.functions.rows import contains, diff_fields, header, value_text
from rowtide.operators import metrics
from rowtide.operators.pairs import feed, pair_updates, typed_changes


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_texts(spark):
    row = F.lit('{"a":1,"b":"it\'s","c":null,"d":true,"e":"x","f":1.5,"g":[1,"q"]}')
    assert one(spark, row_detail(row)) == "a=1, b=\"it's\", c=None, d=True, e='x', f=1.5, g=[1,\"q\"]"
    assert one(spark, shown(F.lit('"a\\\\b\'\\"c"'))) == "'a\\\\b\\'\"c'"
    assert one(spark, quoted_name(F.lit("db.t`1"))) == "`db`.`t``1`"
    assert one(spark, successor_name(F.lit("feed"), F.lit("9"))) == "feed_9"
    assert one(spark, value_text(F.lit(None).cast("string"))) == ""
    time = F.lit("2026-01-01 02:03:04").cast("timestamp_ntz")
    assert one(spark, iso_text(time)) == "2026-01-01T02:03:04" and one(spark, clock_text(time)) == "02:03:04"
    assert one(spark, iso_text(F.lit("2026-01-01 02:03:04.5").cast("timestamp_ntz"))) == "2026-01-01T02:03:04.500000"
    names = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, header(names, F.array(F.lit("c"), F.lit("a")))) == ["a", "b", "c"]
    changes = F.create_map(F.lit("tables_created"), names)
    assert one(spark, contains(changes, "tables_created", F.lit("b"))) is True
    assert one(spark, contains(changes, "other", F.lit("b"))) is False


def test_describe_and_render(log_of):
    log = log_of([("insert", 1, '{"id":1}', 5), ("schema_changed", ["id"]), ("table_dropped",)])
    assert [tuple(r) for r in describe(log).orderBy("seq").collect()] == [
        (1, "changes.1", "insert", "5", "orders", "id=1"), (2, "changes.1", "SCHEMA CHANGE", "2", "orders", "stream restarts here"),
        (3, "changes.1", "TABLE DROPPED", "3", "orders", "stream ended")]
    assert [r[0] for r in log.orderBy("seq").select(render_line()).collect()] == [
        'insert           snapshot 5  {"id":1}', "SCHEMA_CHANGED at snapshot 2", "TABLE_DROPPED at snapshot 3"]


def test_fields_of_an_update(spark):
    updates = spark.createDataFrame([
        (1, '{"a":1,"b":"x","c":null}', '{"a":"1","b":"x","d":2}'), (2, '{"a":1}', '{"a":1}'), (3, None, '{"a":null}')],
        "rowid long, before string, after string")
    found = sorted((tuple(r) for r in diff_fields(updates, ["rowid"]).collect()), key=str)
    assert found == [
        (1, "a", "1", "'1'", None), (1, "c", "None", "∅", None), (1, "d", "∅", "2", None),
        (2, None, None, None, "no value changed"), (3, "a", "∅", "None", None)]


def test_pairs_in_any_order_and_number(log_of):
    pre, post = ("update_preimage", 1, "p", 7), ("update_postimage", 1, "q", 7)
    for events in ([pre, post], [post, pre], [pre, post, pre], [pre, pre, post]):
        found = pair_updates(log_of(events)).collect()
        assert [(r["before"], r["after"]) for r in found] == [("p", "q")]
    assert pair_updates(log_of([pre, pre])).isEmpty()
    lone = pair_updates(log_of([pre]), lone=True).first()
    assert (lone["before"], lone["after"], lone["first_seq"]) == ("p", None, 1)


def test_pairs_are_reduced_in_small_parts(log_of):
    """Rows are dealt before they are reduced, so that no task sorts all rows of a file of the log."""
    log = log_of([("update_preimage", 1, "p", 7), ("update_postimage", 1, "q", 7)] * 3)
    plan = pair_updates(log.withColumn("seq", F.col("seq") * 50_000))  # the copies lie in several stretches
    assert [(r["before"], r["after"], r["first_seq"], r["last_seq"]) for r in plan.collect()] == [("p", "q", 50_000, 100_000)]
    text = plan._jdf.queryExecution().executedPlan().toString()
    lowest = [line for line in text.splitlines() if "Exchange" in line or "Aggregate" in line][-1]
    assert "REPARTITION_BY_COL" in lowest


def test_typed_changes(log_of):
    log = log_of([("insert", 1, "a"), ("update_postimage", 1, "b", 2), ("update_preimage", 1, "a", 2), ("delete", 1, "b", 3), ("schema_changed", [])])
    found = [tuple(r) for r in typed_changes(log).orderBy("seq").select("seq", "type", "snapshot", "row", "before").collect()]
    assert found == [(1, "insert", 1, "a", None), (3, "update", 2, "b", "a"), (4, "delete", 3, None, "b")]


def test_feed_places_an_update_at_its_first_half(log_of):
    log = log_of([
        ("insert", 9, "n"), ("update_preimage", 1, "a", 2), ("insert", 2, "c", 3), ("update_postimage", 1, "b", 2),
        ("schema_changed", ["id"]), ("delete", 2, "c", 6)])
    found = [(r["seq"], r["kind"], r["rowid"], r["before"], r["after"]) for r in feed(log, 4).collect()]
    assert found == [(6, "delete", 2, "c", None), (5, "schema_changed", None, None, None), (3, "insert", 2, None, "c"), (2, "update", 1, "a", "b")]


def test_status_and_lag(spark):
    lit = lambda v, t: F.lit(v).cast(t)
    state = lambda e, x, o: one(spark, metrics.status(lit(e, "string"), F.lit(x), F.lit(o)))
    assert [state("bad", True, True), state(None, True, True), state(None, False, True), state(None, False, False)] == [
        "error", "ended", "online", "offline"]
    assert one(spark, metrics.waiting(F.lit(5), F.lit(9))) == 0 and one(spark, metrics.waiting(F.lit(9), F.lit(5))) == 4


def test_latency(spark):
    log = spark.createDataFrame([("change", 10.0, 11.5), ("change", 10.0, 12.5), ("schema_changed", 1.0, 99.0)], "type string, a double, b double").select(
        "type", F.col("a").cast("timestamp").alias("snapshot_time"), F.col("b").cast("timestamp").alias("published_at"))
    assert metrics.delivery_latency(log, [0.5]).first()["value"] == 2.0
