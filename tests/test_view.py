import itertools
import json
import random

import duckdb
from pyspark.sql import functions as F

from rowtide.operators import view
from rowtide.operators.view import materialize
from rowtide.schemas import VIEW_META


def rows_of(after):
    return {r["rowid"]: dict(r["row"]) for r in after.rows.collect()}


def meta_of(after, table_id=1):
    return after.meta.filter(F.col("table_id") == table_id).first()


A, B = '{"id":1,"v":"a"}', '{"id":1,"v":"b"}'


def test_insert_update_delete(log_of):
    events = [("insert", 1, A), ("update_postimage", 1, B), ("delete", 1, B)]
    assert rows_of(materialize(log_of(events[:2]))) == {1: {"id": "1", "v": "b"}}
    assert rows_of(materialize(log_of(events))) == {}


def test_preimage_after_postimage_changes_nothing(log_of):
    assert rows_of(materialize(log_of([("insert", 1, A), ("update_postimage", 1, B), ("update_preimage", 1, A)]))) == {
        1: {"id": "1", "v": "b"}}


def test_replay_of_all_events(log_of):
    once = [("insert", 1, '{"id":1}'), ("insert", 2, '{"id":2}')]
    assert rows_of(materialize(log_of(once + once))) == rows_of(materialize(log_of(once)))


def test_old_copy_does_not_move_the_view_back(log_of):
    events = [("insert", 1, A), ("update_postimage", 1, B), ("insert", 1, A)]
    assert rows_of(materialize(log_of(events))) == {1: {"id": "1", "v": "b"}}


def test_markers_set_flags(log_of):
    meta = meta_of(materialize(log_of([("schema_changed", None)])))
    assert meta["needs_reload"] and not meta["ended"]
    meta = meta_of(materialize(log_of([("schema_changed", None), ("table_dropped",)])))
    assert meta["needs_reload"] and meta["ended"]


def test_reshape_drop_add_rename(log_of):
    events = [("insert", 1, '{"id":1,"amount":5}'), ("schema_changed", ["id"])]
    assert rows_of(materialize(log_of(events))) == {1: {"id": "1"}}
    events.append(("schema_changed", ["id", "priority"]))
    after = materialize(log_of(events))
    assert rows_of(after) == {1: {"id": "1", "priority": None}}
    assert not meta_of(after)["needs_reload"]
    events.append(("schema_changed", ["id", "p2"]))
    after = materialize(log_of(events))
    assert rows_of(after) == {1: {"id": "1", "priority": None}}
    assert meta_of(after)["needs_reload"] and meta_of(after)["columns"] == ["id", "p2"]


def test_type_change_asks_for_reload(log_of):
    events = [("insert", 1, A), ("schema_changed", ["id", "v"], ["v"])]
    assert meta_of(materialize(log_of(events)))["needs_reload"]


def test_first_event_gives_the_columns_also_when_it_is_a_delete(log_of):
    meta = meta_of(materialize(log_of([("delete", 1, A)])))
    assert meta["columns"] == ["id", "v"] and meta["last_seq"] == 1


def test_unknown_shape_removes_nothing_and_adds_all(log_of):
    after = materialize(log_of([("schema_changed", ["id", "x"]), ("insert", 1, '{"id":1}'), ("schema_changed", ["id", "x", "y"])]))
    assert rows_of(after) == {1: {"id": "1", "y": None}}


def test_nothing_is_applied_after_a_drop(log_of):
    after = materialize(log_of([("insert", 1, A), ("table_dropped",), ("insert", 2, B)]))
    assert list(rows_of(after)) == [1]
    assert meta_of(after)["ended"] and meta_of(after)["last_seq"] == 2


def test_resume_equals_one_pass(log_of, spark):
    events = [
        ("insert", 1, '{"id":1,"amount":5}', 1), ("insert", 2, '{"id":2,"amount":6}', 1), ("schema_changed", ["id", "amount", "x"]),
        ("update_postimage", 2, '{"id":2,"amount":7,"x":"q"}', 4), ("schema_changed", ["id", "x"]), ("delete", 1, '{"id":1}', 6),
        ("insert", 3, '{"id":3,"x":null}', 7), ("schema_changed", None), ("schema_changed", ["id", "x", "z"]),
    ]
    whole = materialize(log_of(events))
    whole_rows, whole_meta = rows_of(whole), meta_of(whole).asDict()
    for cut in (1, 3, 5, 8):
        first = materialize(log_of(events[:cut]), distinct=True)
        saved_rows = spark.createDataFrame(first.rows.collect(), first.rows.schema)
        saved_meta = spark.createDataFrame(first.meta.collect(), VIEW_META)
        rest = materialize(log_of(events[cut:], first=cut + 1), saved_rows, saved_meta, distinct=True)
        assert rows_of(rest) == whole_rows, cut
        assert meta_of(rest).asDict() == whole_meta, cut


EXPECTED = """
WITH ending AS (SELECT coalesce(min(seq), 1000000) AS last FROM ev WHERE kind = 'table_dropped'),
e AS (SELECT * FROM ev, ending WHERE seq <= last),
first_row AS (SELECT seq AS first_seq, json_keys(body) AS shape FROM e WHERE body IS NOT NULL ORDER BY seq LIMIT 1),
marks AS (
  SELECT seq, names,
         last_value(names IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
         (SELECT shape FROM first_row WHERE first_seq < m.seq) AS shape
  FROM e m WHERE kind = 'schema_changed'),
delta AS (
  SELECT seq, names, coalesce(before, shape, []) AS known,
         list_filter(coalesce(before, shape, []), lambda x: NOT list_contains(names, x)) AS lost,
         list_filter(names, lambda x: NOT list_contains(coalesce(before, shape, []), x)) AS won FROM marks),
valid AS (SELECT * FROM delta WHERE names IS NOT NULL AND NOT (len(known) > 0 AND len(lost) > 0 AND len(won) > 0)),
touches AS (SELECT seq, unnest(lost) AS name, false AS adds FROM valid UNION ALL SELECT seq, unnest(won), true FROM valid),
columns AS (SELECT name, max(seq) FILTER (NOT adds) AS lost_at, max(seq) AS touched_at, arg_max(adds, seq) AS is_in
            FROM touches GROUP BY name),
present AS (
  SELECT rowid, arg_max(body, seq) AS body, max(seq) AS place, arg_max(kind, seq) AS kind
  FROM e WHERE kind IN ('insert', 'update_postimage', 'delete') GROUP BY rowid),
cells AS (
  SELECT rowid, place, unnest(json_keys(body)) AS name, body FROM present WHERE kind <> 'delete'),
kept AS (
  SELECT c.rowid, c.name, json_extract_string(c.body, '$.' || c.name) AS value FROM cells c LEFT JOIN columns k USING (name)
  WHERE k.lost_at IS NULL OR k.lost_at < c.place),
new AS (
  SELECT p.rowid, k.name, NULL AS value FROM present p JOIN columns k ON k.is_in AND k.touched_at > p.place
  WHERE p.kind <> 'delete' AND NOT EXISTS (SELECT 1 FROM kept WHERE kept.rowid = p.rowid AND kept.name = k.name))
SELECT (SELECT list({'rowid': rowid, 'name': name, 'value': value}) FROM (SELECT * FROM kept UNION ALL SELECT * FROM new)) AS cells,
       (SELECT list(rowid) FROM present WHERE kind <> 'delete') AS rowids,
       coalesce((SELECT arg_max(names, seq) FROM delta WHERE names IS NOT NULL), (SELECT shape FROM first_row), []) AS columns,
       (SELECT count(*) FROM delta) > (SELECT count(*) FROM valid) AS reload,
       (SELECT last FROM ending) < 1000000 AS ended
"""


def expected_view(events):
    """The same in SQL over the whole log: the last event of every row, and the last touch of every column."""
    con = duckdb.connect()
    con.execute("CREATE TABLE ev (seq BIGINT, kind VARCHAR, rowid BIGINT, body JSON, names VARCHAR[])")
    for seq, e in enumerate(events, 1):
        marker = e[0] in ("schema_changed", "table_dropped")
        names = e[1] if e[0] == "schema_changed" else None
        con.execute("INSERT INTO ev VALUES (?, ?, ?, ?, ?)", [seq, e[0], None if marker else e[1], None if marker else e[2], names])
    cells, rowids, columns, reload, ended = con.execute(EXPECTED).fetchone()
    rows = {i: {} for i in rowids or []}
    for c in cells or []:
        rows[c["rowid"]][c["name"]] = c["value"]
    return rows, columns, reload, ended


def random_events(rng, length):
    events, columns = [], ["id", "a"]
    for snapshot in range(1, length + 1):
        kind = rng.choice(["insert", "update_preimage", "update_postimage", "delete"] * 3 + ["marker"])
        if kind == "marker":
            columns = rng.choice([None, ["id"], ["id", "a"], ["id", "a", "b"], ["id", "b"], ["id", "c"]])
            events.append(("schema_changed", columns))
            columns = columns or ["id"]
        else:
            row = {c: rng.choice([1, "x", None]) if c != "id" else snapshot for c in columns}
            events.append((kind, rng.randrange(4), json.dumps(row), snapshot))
    if rng.random() < 0.3:
        events.insert(rng.randrange(1, length), ("table_dropped",))
    return events


def test_random_logs_equal_sql(log_of):
    rng = random.Random(7)
    histories = [random_events(rng, 25) for _ in range(12)]
    logs = [log_of(h, table_id=t) for t, h in enumerate(histories)]
    joined = logs[0]
    for other in logs[1:]:
        joined = joined.unionByName(other)
    after = materialize(joined)
    found = {t: {} for t in range(len(histories))}
    for r in after.rows.collect():
        found[r["table_id"]][r["rowid"]] = dict(r["row"])
    metas = {r["table_id"]: r for r in after.meta.collect()}
    for t, history in enumerate(histories):
        rows, columns, reload, ended = expected_view(history)
        assert found[t] == rows, history
        assert (metas[t]["columns"], metas[t]["needs_reload"], metas[t]["ended"]) == (columns, reload, ended), history


def test_without_any_broadcast(log_of, never_broadcast):
    rng = random.Random(11)
    history = random_events(rng, 40)
    assert rows_of(materialize(log_of(history))) == expected_view(history)[0]


def test_header_and_order(log_of):
    after = materialize(log_of([("insert", 10, '{"id":10,"z":1}'), ("insert", 9, '{"id":9,"y":1}')]))
    header = view.header_columns(after.rows, after.meta).first()["header"]
    assert header[:2] == ["id", "z"] and set(header) == {"id", "y", "z"}
    assert [r["rowid"] for r in view.in_order(after.rows).collect()] == [9, 10]


def test_last_name(log_of):
    log = log_of([("insert", 1, A), ("insert", 2, A)], name="old").unionByName(log_of([("insert", 3, A)], name="", first=3))
    assert view.last_table_name(log).first()["table"] == "old"


def test_every_order_of_two_halves(log_of):
    events = [("insert", 1, A, 1), ("update_preimage", 1, A, 2), ("update_postimage", 1, B, 2)]
    for order in itertools.permutations(events[1:]):
        assert rows_of(materialize(log_of([events[0], *order]))) == {1: {"id": "1", "v": "b"}}
