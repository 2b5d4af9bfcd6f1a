"""The same results in plain SQL over the given tables, for the driver's comparison."""

ORACLE: dict[str, str] = {}

_V1 = "v1 AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00')"
_V2 = """v2 AS (
  SELECT o_orderkey, o_custkey,
    CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'P' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice,
    o_orderdate, o_orderpriority
  FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'F'))"""
_VERSIONS = f"{_V1}, {_V2}"
_SAME = """o.o_custkey IS NOT DISTINCT FROM n.o_custkey AND o.o_orderstatus IS NOT DISTINCT FROM n.o_orderstatus
  AND o.o_totalprice IS NOT DISTINCT FROM n.o_totalprice AND o.o_orderdate IS NOT DISTINCT FROM n.o_orderdate
  AND o.o_orderpriority IS NOT DISTINCT FROM n.o_orderpriority"""
_JOINED = f"""joined AS (
  SELECT o.o_orderkey AS old_key, n.o_orderkey AS new_key, o AS o, n AS n, ({_SAME}) AS same
  FROM v1 o FULL OUTER JOIN v2 n ON o.o_orderkey = n.o_orderkey)"""
_DIFF = f"""{_VERSIONS}, {_JOINED}, diff AS (
  SELECT new_key AS rowid, 'insert' AS change_type, n AS r FROM joined WHERE old_key IS NULL
  UNION ALL SELECT old_key, 'delete', o FROM joined WHERE new_key IS NULL
  UNION ALL SELECT old_key, 'update_preimage', o FROM joined WHERE old_key IS NOT NULL AND new_key IS NOT NULL AND NOT same
  UNION ALL SELECT new_key, 'update_postimage', n FROM joined WHERE old_key IS NOT NULL AND new_key IS NOT NULL AND NOT same)"""

ORACLE["diff_orders"] = f"""
WITH {_DIFF}
SELECT rowid, change_type, r.o_totalprice AS price, r.o_orderstatus AS status FROM diff"""

ORACLE["diff_counts"] = f"WITH {_DIFF} SELECT change_type, count(*) AS events FROM diff GROUP BY change_type"

ORACLE["diff_append_only"] = f"""
WITH {_V2} SELECT o_orderkey AS rowid, 'insert' AS change_type, o_totalprice AS price FROM v2"""

ORACLE["diff_composite_key"] = """
WITH o AS (SELECT * FROM conversations WHERE role <> 'assistant' OR length(text) > 200),
n AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN text || '!' ELSE text END AS text
  FROM conversations WHERE role <> 'user' OR length(text) > 20),
joined AS (SELECT o.conv_id AS oc, n.conv_id AS nc, o AS o, n AS n FROM o FULL OUTER JOIN n ON o.conv_id = n.conv_id AND o.turn = n.turn),
diff AS (
  SELECT 'insert' AS change_type, n AS r FROM joined WHERE oc IS NULL
  UNION ALL SELECT 'delete', o FROM joined WHERE nc IS NULL
  UNION ALL SELECT 'update_preimage', o FROM joined WHERE oc IS NOT NULL AND nc IS NOT NULL AND o.text <> n.text
  UNION ALL SELECT 'update_postimage', n FROM joined WHERE oc IS NOT NULL AND nc IS NOT NULL AND o.text <> n.text)
SELECT change_type, '{"conv_id":' || r.conv_id || ',"turn":' || r.turn || '}' AS rowkey,
  r.conv_id, r.turn, r.role, r.text FROM diff"""

ORACLE["duplicate_keys"] = """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""

_ORDER_EVENTS = f"""{_DIFF}, changed AS (
  SELECT 1 AS table_id, 'orders' AS table_name, 1 AS snapshot_id, o_orderkey AS rowid, 'insert' AS change_type,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_date, o_orderstatus AS order_status, o_totalprice AS order_price,
    NULL AS customer, '' AS segment FROM v1
  UNION ALL SELECT 1, 'orders', 2, rowid, change_type, strftime(r.o_orderdate, '%Y-%m-%d %H:%M:%S'), r.o_orderstatus,
    r.o_totalprice, NULL, '' FROM diff
  UNION ALL SELECT 2, 'customer', 2, c_custkey, 'insert', NULL, NULL, NULL, c_name, c_mktsegment FROM customer)"""

ORACLE["event_envelope"] = f"""
WITH {_ORDER_EVENTS}
SELECT 'change' AS type, 'changes.' || table_id AS subject,
  table_id || '-' || snapshot_id || '-' || rowid || '-' || change_type AS message_id,
  CAST(table_id AS BIGINT) AS table_id, table_name AS "table", CAST(snapshot_id AS BIGINT) AS snapshot_id, rowid, change_type,
  order_date, order_status, order_price, customer, segment FROM changed"""

ORACLE["nested_rows"] = """
SELECT vec_id AS rowid, label, CAST(i - 1 AS BIGINT) AS place, CAST(embedding[i] AS FLOAT) AS item
FROM (SELECT vec_id, label, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)"""

ORACLE["document_rows"] = "SELECT doc_id, text, lang, n_chars FROM documents"

_KIND = """CASE event_type WHEN 'signup' THEN 'insert' WHEN 'view' THEN 'update_preimage' WHEN 'error' THEN 'delete'
  ELSE 'update_postimage' END"""
_DROP = "(event_type = 'error' AND value >= 150)"
_LOG = f"""log AS (
  SELECT event_id + 1 AS seq, user_id % 4 AS table_id, event_id + 1 AS snapshot_id, user_id AS rowid, {_KIND} AS change_type,
    value, event_type, ts,
    (user_id % 4) || '-' || (event_id + 1) || '-' || user_id || '-' || ({_KIND}) AS message_id
  FROM events)"""

ORACLE["render_lines"] = f"""
SELECT event_id,
  rpad({_KIND}, 16, ' ') || ' snapshot ' || (event_id + 1) || '  {{"id":' || user_id || ',"kind":"' || event_type || '"}}' AS line,
  strftime(ts, '%H:%M:%S') AS clock,
  CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso,
  'reader_' || (event_id + 1) AS successor, '`main`.`t' || event_id || '`' AS quoted
FROM events"""

ORACLE["dump_log"] = f"""
SELECT event_id + 1 AS seq, 'changes.' || user_id AS subject,
  CASE WHEN {_DROP} THEN 'TABLE DROPPED' WHEN event_type = 'view' THEN 'SCHEMA CHANGE' ELSE {_KIND} END AS kind,
  CAST(event_id + 1 AS VARCHAR) AS snapshot, 't' || user_id AS "table",
  CASE WHEN {_DROP} THEN 'stream ended' WHEN event_type = 'view' THEN 'stream restarts here'
    ELSE 'id=' || user_id || ', kind=''' || event_type || '''' END AS detail
FROM events"""

ORACLE["log_dedup"] = f"""
WITH {_LOG}, doubled AS (
  SELECT message_id, seq, table_id, rowid, change_type FROM log
  UNION ALL SELECT message_id, seq + 1000000000000, table_id, rowid, change_type FROM log),
ranked AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY seq) AS copy FROM doubled)
SELECT message_id, seq, table_id, rowid, change_type FROM ranked WHERE copy = 1"""

ORACLE["dedup_publish"] = f"""
WITH {_LOG} SELECT message_id, seq FROM log
WHERE message_id NOT IN (SELECT message_id FROM log WHERE change_type <> 'delete')"""

_COMMITS = f"""commits AS (
  SELECT event_id + 1 AS snapshot_id, user_id AS table_id, 'user_' || user_id AS table_name, {_DROP} AS is_drop,
    event_type AS shape FROM events),
alive AS (
  SELECT c.* FROM commits c LEFT JOIN (SELECT table_id, min(snapshot_id) AS dropped_at FROM commits WHERE is_drop GROUP BY table_id) d
    USING (table_id) WHERE d.dropped_at IS NULL OR c.snapshot_id <= d.dropped_at),
flagged AS (
  SELECT *, CASE WHEN is_drop THEN 0
    WHEN shape IS DISTINCT FROM lag(shape) OVER (PARTITION BY table_id ORDER BY snapshot_id) THEN 1 ELSE 0 END AS begins FROM alive),
numbered AS (
  SELECT *, sum(begins) OVER (PARTITION BY table_id ORDER BY snapshot_id ROWS UNBOUNDED PRECEDING) AS epoch FROM flagged),
starts AS (SELECT table_id, epoch, snapshot_id AS start_snapshot, table_name, shape FROM numbered WHERE begins = 1),
drops AS (SELECT table_id, snapshot_id AS dropped_at, epoch FROM numbered WHERE is_drop),
ep AS (
  SELECT s.table_id, s.epoch, s.start_snapshot, s.table_name, s.shape,
    coalesce(lead(s.start_snapshot) OVER (PARTITION BY s.table_id ORDER BY s.epoch), d.dropped_at) AS end_snapshot,
    CASE WHEN lead(s.start_snapshot) OVER (PARTITION BY s.table_id ORDER BY s.epoch) IS NOT NULL THEN 'schema_changed'
      WHEN d.dropped_at IS NOT NULL THEN 'table_dropped' END AS end_kind
  FROM starts s LEFT JOIN drops d ON s.table_id = d.table_id AND s.epoch = d.epoch)"""

ORACLE["log_seq"] = f"""
WITH {_LOG}, {_COMMITS}, everything AS (
  SELECT message_id, snapshot_id, 1 AS rank, table_id, rowid, CASE WHEN change_type = 'update_postimage' THEN 1 ELSE 0 END AS image FROM log
  UNION ALL
  SELECT end_kind || '-' || table_id || '-' || end_snapshot, end_snapshot,
    CASE WHEN end_kind = 'table_dropped' THEN 2 ELSE 0 END, table_id, NULL, 0 FROM ep WHERE end_kind IS NOT NULL)
SELECT row_number() OVER (ORDER BY snapshot_id, rank, table_id, rowid, image) AS seq, message_id FROM everything"""

ORACLE["replay_from"] = f"""
WITH {_LOG} SELECT seq, message_id, snapshot_id, rowid, change_type FROM log
WHERE table_id = 2 AND seq > (SELECT count(*) // 2 FROM events)"""

ORACLE["publish_again"] = f"""
WITH {_LOG} SELECT table_id, count(*) AS events, min(seq) AS first_seq, max(seq) AS last_seq FROM log GROUP BY table_id"""

ORACLE["publish_late_copies"] = f"""
WITH {_LOG}, new AS (SELECT table_id FROM log WHERE snapshot_id % 5 = 0)
SELECT table_id, count(*) + (SELECT count(*) FROM new n WHERE n.table_id = log.table_id) AS events,
  count(*) + (SELECT count(*) FROM new n WHERE n.table_id = log.table_id) AS ids, min(seq) AS first_seq FROM log GROUP BY table_id"""

ORACLE["log_bounds"] = f"WITH {_LOG} SELECT min(seq) AS first_seq, max(seq) AS last_seq FROM log"

ORACLE["retained_bounds"] = f"""
WITH {_LOG} SELECT min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS held FROM log
WHERE seq > (SELECT (max(event_id) + 1) // 3 FROM events)"""

ORACLE["too_old"] = """
WITH bounds AS (SELECT min(event_id) FILTER (WHERE ts >= TIMESTAMP '2024-01-16 00:00:00') + 1 AS f, max(event_id) + 1 AS l FROM events),
readers AS (SELECT user_id, event_type, min(event_id) + 1 AS last_seq FROM events GROUP BY user_id, event_type)
SELECT user_id, event_type, last_seq,
  CASE WHEN f > 0 AND last_seq + 1 < f THEN 'too_old' WHEN last_seq > l THEN 'log_was_reset' ELSE 'resume' END AS state
FROM readers, bounds"""

ORACLE["batch_counts"] = """
SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS batch_id, count(*) AS events,
  max(event_id) + 1 AS end_snapshot FROM events GROUP BY 1"""

ORACLE["event_counts"] = f"WITH {_LOG} SELECT table_id, change_type AS kind, count(*) AS events FROM log GROUP BY ALL"

_LAST = f"""{_LOG}, last AS (
  SELECT *, row_number() OVER (PARTITION BY table_id, rowid ORDER BY seq DESC) AS back FROM log WHERE change_type <> 'update_preimage'),
held AS (SELECT * FROM last WHERE back = 1 AND change_type <> 'delete')"""

ORACLE["materialize_events"] = f"WITH {_LAST} SELECT table_id, rowid, value, seq FROM held"
ORACLE["materialize_orders"] = f"WITH {_V2} SELECT * FROM v2"
ORACLE["late_copies"] = f"WITH {_LAST} SELECT table_id, rowid, event_type AS kind, seq FROM held"
ORACLE["view_in_order"] = f"WITH {_LAST} SELECT table_id, rowid, seq FROM held ORDER BY table_id, rowid"

ORACLE["stop_at_drop"] = f"""
WITH log AS (SELECT event_id + 1 AS seq, user_id AS table_id, CASE WHEN {_DROP} THEN 'table_dropped' ELSE 'change' END AS type FROM events),
points AS (SELECT table_id, min(seq) AS ended FROM log WHERE type = 'table_dropped' GROUP BY table_id)
SELECT seq, log.table_id, type FROM log LEFT JOIN points USING (table_id) WHERE ended IS NULL OR seq <= ended"""

ORACLE["replay_to_drop"] = f"""
WITH log AS (SELECT event_id + 1 AS seq, user_id % 20 AS table_id, {_DROP} AS is_drop FROM events),
points AS (SELECT table_id, min(seq) AS ended FROM log WHERE is_drop GROUP BY table_id)
SELECT seq, CASE WHEN is_drop THEN 'table_dropped' ELSE 'change' END AS type, log.table_id,
  CASE WHEN NOT is_drop THEN 'insert' END AS change_type
FROM log LEFT JOIN points USING (table_id) WHERE ended IS NULL OR seq <= ended"""
ORACLE["marker_index"] = f"""
SELECT event_id + 1 AS seq, 'table_dropped' AS type, user_id % 20 AS table_id FROM events WHERE {_DROP}"""

_NAMES = """CASE WHEN event_type <> 'error' THEN list_filter(
    ['id', CASE WHEN value > 20 THEN 'amount' END, CASE WHEN event_type IN ('click', 'purchase') THEN 'priority' END],
    lambda x: x IS NOT NULL) END"""


def _text(expression: str) -> str:
    return f"coalesce(array_to_string(list_sort({expression}), ','), '')"


ORACLE["marker_delta"] = f"""
WITH markers AS (SELECT user_id AS table_id, event_id + 1 AS seq, {_NAMES} AS columns FROM events),
looked AS (SELECT *, coalesce(last_value(columns IGNORE NULLS) OVER
    (PARTITION BY table_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS known FROM markers),
delta AS (SELECT *, list_filter(known, lambda x: NOT list_contains(columns, x)) AS removed,
    list_filter(columns, lambda x: NOT list_contains(known, x)) AS added FROM looked)
SELECT table_id, seq, {_text('known')} AS known,
  CASE WHEN columns IS NULL THEN '' ELSE {_text('removed')} END AS removed,
  CASE WHEN columns IS NULL THEN '' ELSE {_text('added')} END AS added,
  columns IS NULL OR (len(known) > 0 AND len(removed) > 0 AND len(added) > 0) AS skip FROM delta"""

_MIXED = f"""mixed AS (
  SELECT user_id AS table_id, event_id + 1 AS seq, event_type IN ('view', 'signup') AS writes,
    CASE WHEN event_type NOT IN ('view', 'signup') THEN {_NAMES} END AS columns, CAST(floor(value) AS BIGINT) AS rowid,
    event_id AS amount FROM events),
shapes AS (SELECT table_id, min(seq) AS shape_seq FROM mixed WHERE writes GROUP BY table_id),
markers AS (SELECT table_id, seq, columns FROM mixed WHERE NOT writes),
looked AS (SELECT m.*, coalesce(
    last_value(columns IGNORE NULLS) OVER (PARTITION BY m.table_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    CASE WHEN shape_seq < seq THEN ['id', 'amount'] END, []) AS known FROM markers m LEFT JOIN shapes s ON m.table_id = s.table_id),
delta AS (SELECT *, list_filter(known, lambda x: NOT list_contains(columns, x)) AS removed,
    list_filter(columns, lambda x: NOT list_contains(known, x)) AS added FROM looked),
skipped AS (SELECT *, columns IS NULL OR (len(known) > 0 AND len(removed) > 0 AND len(added) > 0) AS skip FROM delta),
touches AS (
  SELECT table_id, seq, unnest(removed) AS name, FALSE AS adds FROM skipped WHERE NOT skip
  UNION ALL SELECT table_id, seq, unnest(added), TRUE FROM skipped WHERE NOT skip),
stored AS (
  SELECT table_id, rowid, seq, amount FROM (
    SELECT *, row_number() OVER (PARTITION BY table_id, rowid ORDER BY seq DESC) AS back FROM mixed WHERE writes) WHERE back = 1),
later AS (
  SELECT s.table_id, s.rowid, t.name, arg_max(t.adds, t.seq) AS present, bool_or(NOT t.adds) AS lost
  FROM stored s JOIN touches t ON s.table_id = t.table_id AND t.seq > s.seq GROUP BY ALL)"""


def _fate(name: str) -> str:
    return f"LEFT JOIN (SELECT * FROM later WHERE name = '{name}') f_{name} ON s.table_id = f_{name}.table_id AND s.rowid = f_{name}.rowid"


ORACLE["reshape"] = f"""
WITH {_MIXED}
SELECT s.table_id, s.rowid, coalesce(f_id.present, TRUE) AS has_id, coalesce(f_amount.present, TRUE) AS has_amount,
  coalesce(f_priority.present, FALSE) AS has_priority,
  CASE WHEN coalesce(f_amount.present, TRUE) AND NOT coalesce(f_amount.lost, FALSE) THEN s.amount END AS amount
FROM stored s {_fate('id')} {_fate('amount')} {_fate('priority')}"""

_META = f"""{_MIXED}, meta AS (
  SELECT m.table_id, max(m.seq) AS last_seq,
    coalesce(arg_max(m.columns, m.seq) FILTER (WHERE m.columns IS NOT NULL), CASE WHEN max(CAST(writes AS INT)) = 1 THEN ['id', 'amount'] END, []) AS columns
  FROM mixed m GROUP BY m.table_id),
flags AS (SELECT table_id, bool_or(skip) AS reload FROM skipped GROUP BY table_id)"""

ORACLE["needs_reload"] = f"""
WITH {_META} SELECT meta.table_id, last_seq, {_text('columns')} AS columns, coalesce(reload, FALSE) AS needs_reload, FALSE AS ended
FROM meta LEFT JOIN flags ON meta.table_id = flags.table_id"""

ORACLE["first_shapes"] = f"WITH {_MIXED} SELECT table_id, shape_seq, 'id,amount' AS shape FROM shapes"

ORACLE["last_table_name"] = f"""
WITH {_LOG} SELECT table_id,
  arg_max('t' || table_id || '_' || change_type, seq) FILTER (WHERE change_type <> 'delete') AS "table" FROM log GROUP BY table_id"""

ORACLE["header_columns"] = f"""
WITH {_META}, kept AS (
  SELECT s.table_id, coalesce(f_id.present, TRUE) AS has_id, coalesce(f_amount.present, TRUE) AS has_amount,
    coalesce(f_priority.present, FALSE) AS has_priority
  FROM stored s {_fate('id')} {_fate('amount')} {_fate('priority')}),
names AS (
  SELECT table_id, 'id' AS name FROM kept WHERE has_id UNION SELECT table_id, 'amount' FROM kept WHERE has_amount
  UNION SELECT table_id, 'priority' FROM kept WHERE has_priority
  UNION SELECT table_id, unnest(columns) FROM meta)
SELECT meta.table_id, coalesce(string_agg(name, ',' ORDER BY name), '') AS header
FROM meta LEFT JOIN names ON meta.table_id = names.table_id GROUP BY meta.table_id"""

ORACLE["reader_status"] = f"""
WITH {_LAST}, kept AS (SELECT table_id, count(*) AS rows FROM held GROUP BY table_id)
SELECT 'online' AS status, l.table_id, 't' || l.table_id AS "table", 'changes.' || l.table_id AS channel, count(*) AS received,
  max(l.seq) AS last_seq, (SELECT max(seq) FROM log) AS head, (SELECT max(seq) FROM log) - max(l.seq) AS waiting,
  FALSE AS needs_reload, FALSE AS ended, any_value(coalesce(kept.rows, 0)) AS rows
FROM log l LEFT JOIN kept ON l.table_id = kept.table_id GROUP BY l.table_id"""

ORACLE["epochs"] = f"WITH {_COMMITS} SELECT table_id, CAST(epoch AS INT) AS epoch, start_snapshot, end_snapshot, end_kind FROM ep"

ORACLE["latest_epoch"] = f"""
WITH {_COMMITS} SELECT table_id, CAST(max(epoch) AS INT) AS epoch, max(start_snapshot) AS start_snapshot FROM ep GROUP BY table_id"""

ORACLE["assign_epoch"] = f"""
WITH {_COMMITS} SELECT e.user_id AS table_id, e.event_id + 1 AS snapshot_id, CAST(ep.epoch AS INT) AS epoch
FROM events e LEFT JOIN ep ON e.user_id = ep.table_id AND e.event_id + 1 >= ep.start_snapshot
  AND (ep.end_snapshot IS NULL OR e.event_id + 1 < ep.end_snapshot)"""

ORACLE["at_boundary"] = f"""
WITH {_COMMITS} SELECT table_id, CAST(epoch AS INT) AS epoch, end_snapshot IS NOT NULL AS terminal, end_snapshot AS terminal_at_snapshot FROM ep"""

ORACLE["live_epochs"] = f"WITH {_COMMITS} SELECT table_id, CAST(epoch AS INT) AS epoch FROM ep WHERE end_snapshot IS NULL"

_READERS = f"""{_COMMITS}, readers AS (
  SELECT CASE WHEN epoch = 1 THEN 'reader' ELSE 'reader_' || start_snapshot END AS consumer, table_id, table_name AS "table",
    CASE end_kind WHEN 'table_dropped' THEN 'dropped' WHEN 'schema_changed' THEN 'ended' ELSE 'active' END AS status FROM ep)"""

ORACLE["consumers"] = f"WITH {_READERS} SELECT * FROM readers"
ORACLE["consumer_lookup"] = f"""WITH {_READERS} SELECT table_id, "table" FROM readers WHERE consumer = 'reader'"""
ORACLE["existing_names"] = f"WITH {_READERS} SELECT DISTINCT consumer FROM readers"
ORACLE["dropped_names"] = f"""WITH {_READERS} SELECT table_id, "table" AS dropped_name FROM readers WHERE status = 'dropped'"""
ORACLE["create_if_absent"] = f"""
WITH {_COMMITS} SELECT table_id, start_snapshot, CAST(epoch AS INT) AS epoch FROM ep WHERE epoch > 1"""

ORACLE["created_snapshot"] = """
SELECT min(event_id) + 1 AS created_snapshot FROM events
WHERE event_type = 'signup' AND 'user_' || user_id = 'user_1' AND event_id + 1 > 100"""

ORACLE["recreated"] = f"""
SELECT 'user_' || d.user_id AS "table", d.event_id + 1 AS dropped_at, min(c.event_id) + 1 AS created_snapshot
FROM (SELECT * FROM events WHERE {_DROP}) d
LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') c ON c.user_id = d.user_id AND c.event_id > d.event_id
GROUP BY d.user_id, d.event_id"""

_UPDATES = f"{_DIFF}, updates AS (SELECT old_key AS rowid, o, n FROM joined WHERE old_key IS NOT NULL AND new_key IS NOT NULL AND NOT same)"

ORACLE["pair_updates"] = f"""
WITH {_UPDATES} SELECT CAST(1 AS BIGINT) AS table_id, CAST(2 AS BIGINT) AS snapshot_id, rowid,
  o.o_totalprice AS price_before, n.o_totalprice AS price_after FROM updates"""

_HALVES = """
WITH halves AS (
  SELECT event_id + 1 AS seq, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS snapshot_id, user_id AS rowid,
    event_type = 'view' AS pre, event_type || ' ' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS payload
  FROM events WHERE event_type IN ('view', 'click')),
grouped AS (
  SELECT snapshot_id, rowid, max(payload) FILTER (WHERE pre) AS before, max(payload) FILTER (WHERE NOT pre) AS after,
    min(seq) FILTER (WHERE pre) AS p, min(seq) FILTER (WHERE NOT pre) AS q FROM halves GROUP BY snapshot_id, rowid)
SELECT snapshot_id, rowid, before, after, least(p, q) AS first_seq, greatest(p, q) AS last_seq
FROM grouped WHERE before IS NOT NULL AND after IS NOT NULL"""
ORACLE["pair_copies"] = _HALVES
ORACLE["pair_stream"] = _HALVES

_TYPED = f"""typed AS (
  SELECT 'insert' AS type, 1 AS snapshot, o_orderkey AS rowid, o_orderstatus AS status, NULL AS status_before FROM v1
  UNION ALL SELECT 'insert', 2, rowid, r.o_orderstatus, NULL FROM diff WHERE change_type = 'insert'
  UNION ALL SELECT 'delete', 2, rowid, NULL, r.o_orderstatus FROM diff WHERE change_type = 'delete'
  UNION ALL SELECT 'update', 2, rowid, n.o_orderstatus, o.o_orderstatus FROM updates)"""
ORACLE["typed_changes"] = f"""
WITH {_UPDATES}, {_TYPED} SELECT type, CAST(snapshot AS BIGINT) AS snapshot, rowid, status, status_before FROM typed"""

ORACLE["diff_fields"] = f"""
WITH {_UPDATES}
SELECT rowid, 'o_orderstatus' AS field, '''' || o.o_orderstatus || '''' AS from_text, '''' || n.o_orderstatus || '''' AS to_text,
  CAST(NULL AS DOUBLE) AS from_number, CAST(NULL AS DOUBLE) AS to_number
FROM updates WHERE o.o_orderstatus IS DISTINCT FROM n.o_orderstatus
UNION ALL
SELECT rowid, 'o_totalprice', NULL, NULL, o.o_totalprice, n.o_totalprice
FROM updates WHERE o.o_totalprice IS DISTINCT FROM n.o_totalprice"""

ORACLE["feed_top60"] = f"""
WITH {_LOG} SELECT seq, CASE WHEN change_type LIKE 'update%' THEN 'update' ELSE change_type END AS kind, table_id,
  snapshot_id AS snapshot, rowid FROM log ORDER BY seq DESC LIMIT 60"""

ORACLE["feed_pairs"] = f"""
WITH {_UPDATES}, entries AS (
  SELECT 2 AS s, rowid, change_type AS kind, CASE WHEN change_type = 'delete' THEN r.o_orderstatus END AS before,
    CASE WHEN change_type = 'insert' THEN r.o_orderstatus END AS after FROM diff WHERE change_type IN ('insert', 'delete')
  UNION ALL SELECT 2, rowid, 'update', o.o_orderstatus, n.o_orderstatus FROM updates
  UNION ALL SELECT 1, o_orderkey, 'insert', NULL, o_orderstatus FROM v1)
SELECT kind, rowid, before, after FROM entries ORDER BY s DESC, rowid DESC LIMIT 60"""

ORACLE["lag_by_reader"] = f"""
WITH {_LOG}, heads AS (SELECT table_id, max(seq) AS table_head FROM log GROUP BY table_id),
readers AS (SELECT table_id, rowid, min(seq) AS last_seq FROM log GROUP BY table_id, rowid),
lags AS (SELECT r.*, (SELECT max(seq) FROM log) - last_seq AS waiting, table_head - last_seq AS waiting_table
  FROM readers r JOIN heads h ON r.table_id = h.table_id)
SELECT *, CASE WHEN waiting_table = 0 THEN 'ended' WHEN waiting < 5000 THEN 'online' ELSE 'offline' END AS state FROM lags"""

ORACLE["latency_percentiles"] = """
WITH n AS (SELECT ts, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events),
d AS (SELECT CAST(epoch_us(after) - epoch_us(ts) AS DOUBLE) / 1000000.0 AS s FROM n WHERE after IS NOT NULL)
SELECT CAST(0.5 AS DOUBLE) AS fraction, quantile_cont(s, 0.5) AS value FROM d
UNION ALL SELECT CAST(0.9 AS DOUBLE), quantile_cont(s, 0.9) FROM d
UNION ALL SELECT CAST(0.99 AS DOUBLE), quantile_cont(s, 0.99) FROM d"""

# --- lake and streams ---

_V4 = """v4 AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  CASE WHEN o_totalprice > 400000 THEN 1 WHEN o_totalprice > 200000 THEN 2 END AS priority FROM v2)"""
# Snapshots: 1 create, 2 change and customer, 3 drop column, 4 add column, 5 fill it, 6 rename it, 7 drop, 8 create again.
_CAPTURED = f"""{_UPDATES}, {_V4}, captured AS (
  SELECT 'change' AS type, 1 AS table_id, 1 AS snapshot_id, o_orderkey AS rowid, 'insert' AS change_type, o_orderstatus AS status,
    o_totalprice AS price, o_orderpriority AS order_priority, CAST(NULL AS INT) AS priority, CAST(NULL AS VARCHAR) AS customer FROM v1
  UNION ALL SELECT 'change', 1, 2, rowid, change_type, r.o_orderstatus, r.o_totalprice, r.o_orderpriority, NULL, NULL FROM diff
  UNION ALL SELECT 'change', 2, 2, c_custkey, 'insert', NULL, NULL, NULL, NULL, c_name FROM customer
  UNION ALL SELECT 'schema_changed', 1, 3, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  UNION ALL SELECT 'schema_changed', 1, 4, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  UNION ALL SELECT 'change', 1, 5, o_orderkey, 'update_preimage', o_orderstatus, o_totalprice, NULL, NULL, NULL FROM v4 WHERE priority IS NOT NULL
  UNION ALL SELECT 'change', 1, 5, o_orderkey, 'update_postimage', o_orderstatus, o_totalprice, NULL, priority, NULL FROM v4 WHERE priority IS NOT NULL
  UNION ALL SELECT 'schema_changed', 1, 6, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  UNION ALL SELECT 'table_dropped', 1, 7, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  UNION ALL SELECT 'change', 3, 8, o_orderkey, 'insert', o_orderstatus, o_totalprice, NULL, NULL, NULL FROM v2),
identified AS (
  SELECT *, CASE WHEN type = 'change' THEN table_id || '-' || snapshot_id || '-' || rowid || '-' || change_type
    ELSE type || '-' || table_id || '-' || snapshot_id END AS message_id FROM captured)"""

ORACLE["capture_stream"] = f"""
WITH {_CAPTURED} SELECT message_id, 'changes.' || table_id AS subject, type, CAST(table_id AS BIGINT) AS table_id,
  CASE WHEN table_id = 2 THEN 'customer' ELSE 'orders' END AS "table", CAST(snapshot_id AS BIGINT) AS snapshot_id, change_type
FROM identified"""

ORACLE["capture_order"] = f"""
WITH {_CAPTURED}, placed AS (
  SELECT *, row_number() OVER (ORDER BY snapshot_id, CASE type WHEN 'change' THEN 1 WHEN 'table_dropped' THEN 2 ELSE 0 END, table_id) AS seq
  FROM identified)
SELECT CAST(snapshot_id AS BIGINT) AS snapshot_id, type, CAST(table_id AS BIGINT) AS table_id, min(seq) AS first_seq,
  max(seq) AS last_seq, count(*) AS events, count(*) AS places FROM placed GROUP BY snapshot_id, type, table_id"""

ORACLE["capture_rows"] = f"""
WITH {_CAPTURED} SELECT message_id, status, price, order_priority, priority, customer FROM identified WHERE type = 'change'"""

ORACLE["snapshot_history"] = """
SELECT row_number() OVER (ORDER BY event_id) AS position, event_id + 1 AS snapshot_id,
  CASE WHEN event_type = 'signup' THEN 'user_' || user_id ELSE '' END AS created
FROM events WHERE event_id + 1 > 100"""

_BASE = "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate"
ORACLE["columns_at"] = f"""
WITH e AS (SELECT user_id, event_id, event_type, {_DROP} AS is_drop FROM events),
b AS (SELECT user_id, event_id,
    last_value(CASE WHEN NOT is_drop THEN event_type END IGNORE NULLS) OVER w AS shape, bool_or(is_drop) OVER w AS gone
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id AS table_id, event_id AS snapshot_id, CASE WHEN coalesce(gone, FALSE) OR shape IS NULL THEN '' ELSE shape END AS columns,
  coalesce(gone, FALSE) OR shape IS NULL AS unknown FROM b"""

ORACLE["captured_epochs"] = f"""
WITH {_CAPTURED}
SELECT CAST(t AS BIGINT) AS table_id, n AS "table", e AS epoch, CAST(s AS BIGINT) AS start_snapshot,
  CAST(x AS BIGINT) AS end_snapshot, k AS end_kind, c AS columns,
  (SELECT count(*) FROM captured d WHERE d.type = 'change' AND d.table_id = t AND d.snapshot_id >= s
    AND (x IS NULL OR d.snapshot_id < x)) AS changes FROM (VALUES
  (1, 'orders', 1, 1, 3, 'schema_changed', '{_BASE},o_orderpriority'), (1, 'orders', 2, 3, 4, 'schema_changed', '{_BASE}'),
  (1, 'orders', 3, 4, 6, 'schema_changed', '{_BASE},priority'), (1, 'orders', 4, 6, 7, 'table_dropped', '{_BASE},p2'),
  (2, 'customer', 1, 2, NULL, NULL, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment'),
  (3, 'orders', 1, 8, NULL, NULL, '{_BASE}')) v(t, n, e, s, x, k, c)"""

ORACLE["read_version"] = f"WITH {_V1} SELECT * FROM v1"
ORACLE["read_latest"] = f"WITH {_V2} SELECT * EXCLUDE (o_orderpriority) FROM v2"
ORACLE["reload_view"] = f"WITH {_V2} SELECT * FROM v2"

ORACLE["follow_stream"] = f"""
WITH {_V2}, {_V4} SELECT o_orderkey AS rowid, o_orderstatus AS status, o_totalprice AS price, priority, FALSE AS old_column FROM v4"""

ORACLE["follow_status"] = """
SELECT 'offline' AS status, 'customer' AS "table", 'changes.2' AS channel, count(*) AS received, count(*) AS rows,
  CAST(0 AS BIGINT) AS waiting_table, FALSE AS needs_reload, FALSE AS ended FROM customer"""

ORACLE["subscription"] = f"""
WITH {_UPDATES}, {_V4}, {_TYPED}
SELECT type, CAST(snapshot AS BIGINT) AS snapshot, rowid, status, status_before FROM typed
UNION ALL SELECT 'update', 5, o_orderkey, o_orderstatus, o_orderstatus FROM v4 WHERE priority IS NOT NULL"""

ORACLE["dedup_window"] = "SELECT event_id, user_id, user_id || '-' || event_id AS message_id FROM events"

ORACLE["activity_feed"] = f"""
WITH {_LOG} SELECT seq, CASE WHEN change_type LIKE 'update%' THEN 'update' ELSE change_type END AS kind,
  snapshot_id AS snapshot, rowid FROM log WHERE table_id = 3 ORDER BY seq DESC LIMIT 60"""

ORACLE["ad_hoc_sql"] = f"""
WITH {_V2} SELECT c_mktsegment AS segment, count(*) AS orders, count(DISTINCT o_custkey) AS customers
FROM v2 JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"""

ORACLE["pair_stream_copies"] = _HALVES

ORACLE["pair_stream_batches"] = """
WITH halves AS (
  SELECT event_id + 1 AS seq, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS snapshot_id, user_id AS rowid,
    event_type = 'view' AS pre, event_type || ' ' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS payload,
    event_id * 10 // (SELECT count(*) FROM events) AS batch
  FROM events WHERE event_type IN ('view', 'click')),
complete AS (
  SELECT snapshot_id, rowid, greatest(min(batch) FILTER (WHERE pre), min(batch) FILTER (WHERE NOT pre)) AS batch
  FROM halves GROUP BY snapshot_id, rowid HAVING bool_or(pre) AND bool_or(NOT pre)),
grouped AS (
  SELECT h.snapshot_id, h.rowid, max(payload) FILTER (WHERE pre) AS before, max(payload) FILTER (WHERE NOT pre) AS after,
    min(seq) FILTER (WHERE pre) AS p, min(seq) FILTER (WHERE NOT pre) AS q
  FROM halves h JOIN complete c ON h.snapshot_id = c.snapshot_id AND h.rowid = c.rowid AND h.batch <= c.batch
  GROUP BY h.snapshot_id, h.rowid)
SELECT snapshot_id, rowid, before, after, least(p, q) AS first_seq, greatest(p, q) AS last_seq FROM grouped"""

ORACLE["feed_negative_ids"] = f"""
WITH {_LOG} SELECT seq, CASE WHEN change_type LIKE 'update%' THEN 'update' ELSE change_type END AS kind, table_id,
  snapshot_id AS snapshot, rowid - 1000000 AS rowid FROM log ORDER BY seq DESC LIMIT 60"""

ORACLE["log_seq_groups"] = """
WITH n AS (SELECT user_id % 4 AS table_id, event_id + 1 AS snapshot_id, row_number() OVER (ORDER BY event_id) AS i FROM events)
SELECT 2 * i - 1 AS seq, 'schema_changed' AS type, table_id, snapshot_id FROM n
UNION ALL SELECT 2 * i, 'change', table_id, snapshot_id FROM n"""

ORACLE["follow_composite_key"] = """
SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN text || '!' ELSE text END AS text FROM conversations"""

ORACLE["subscription_markers"] = f"""
WITH {_UPDATES}, {_V4}, {_TYPED},
early AS (SELECT count(*) AS n FROM typed), late AS (SELECT count(*) AS n FROM v4 WHERE priority IS NOT NULL)
SELECT CAST(p AS BIGINT) AS place, k AS kind, c AS columns,
  (SELECT n FROM early) + CASE WHEN p > 2 THEN (SELECT n FROM late) ELSE 0 END AS changes
FROM (VALUES (1, 'schema_changed', '{_BASE}'), (2, 'schema_changed', '{_BASE},priority'),
  (3, 'schema_changed', '{_BASE},p2'), (4, 'table_dropped', NULL)) v(p, k, c)"""

ORACLE["reader_restarts"] = f"""
WITH {_LOG}, t AS (SELECT * FROM log WHERE table_id = 1), head AS (SELECT max(seq) AS head FROM log),
cuts AS (SELECT 'half' AS step, head // 3 AS upto FROM head UNION ALL SELECT 'resumed', head FROM head),
last AS (SELECT step, rowid, arg_max(change_type, seq) AS kind FROM t JOIN cuts ON seq <= upto
  WHERE change_type <> 'update_preimage' GROUP BY step, rowid),
present AS (SELECT step, count(*) AS rows FROM last WHERE kind <> 'delete' GROUP BY step)
SELECT step, max(seq) AS last_seq, count(*) AS received, any_value(present.rows) AS rows
FROM t JOIN cuts ON seq <= upto JOIN present USING (step) GROUP BY step
UNION ALL SELECT s, head, 0, 0 FROM head, (VALUES ('at end'), ('started over')) v(s)"""

ORACLE["follow_many_shapes"] = """
SELECT c_custkey AS rowid, 'c_acctbal,c_custkey,c_name,x11,x19,x3,x5' AS columns, c_name AS name,
  CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 3 END AS x3, CAST(NULL AS BIGINT) AS x5,
  CASE WHEN c_custkey % 3 = 2 THEN c_custkey * 11 END AS x11, CAST(NULL AS BIGINT) AS x19 FROM customer"""

ORACLE["diff_nested"] = """
SELECT DISTINCT conv_id AS rowid, k AS change_type, CASE WHEN k = 'update_postimage' THEN CAST(conv_id AS BIGINT) END AS extra
FROM conversations, (VALUES ('update_preimage'), ('update_postimage')) v(k) WHERE conv_id % 3 = 0"""

ORACLE["follow_typed"] = """
WITH roles AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL
  UNION ALL SELECT DISTINCT conv_id, 'extra', conv_id FROM conversations WHERE conv_id % 3 = 0),
maps AS (SELECT conv_id, string_agg(role || '=' || n, ',' ORDER BY role) AS by_role FROM roles GROUP BY conv_id),
said AS (SELECT conv_id, string_agg(turn || ':' || role, ',' ORDER BY turn) AS turns, arg_min(text, turn) AS text
  FROM conversations GROUP BY conv_id)
SELECT conv_id, hex(encode(left(text, 40))) AS payload, hex(encode(CAST(conv_id AS VARCHAR))) AS raw,
  CAST(CAST(conv_id / 8 AS DECIMAL(20, 3)) AS DOUBLE) AS price, turns, by_role FROM said JOIN maps USING (conv_id)"""

ORACLE["bootstrap_positions"] = f"""
WITH {_CAPTURED}
SELECT CAST(s AS VARCHAR) AS starting, count(*) AS events, CAST(min(snapshot_id) AS BIGINT) AS first_snapshot
FROM captured JOIN (VALUES (2), (5)) v(s) ON snapshot_id > s GROUP BY s
UNION ALL SELECT 'latest', 0, NULL UNION ALL SELECT 'later', count(*), 2 FROM region"""

ORACLE["capture_after_failure"] = f"""
WITH {_CAPTURED} SELECT message_id, type, CAST(table_id AS BIGINT) AS table_id, CAST(snapshot_id AS BIGINT) AS snapshot_id, TRUE AS died
FROM identified"""
ORACLE["rebuilt_log"] = f"""
WITH {_CAPTURED} SELECT message_id, type, CAST(table_id AS BIGINT) AS table_id, CAST(snapshot_id AS BIGINT) AS snapshot_id FROM identified"""

ORACLE["reset_readers"] = """
WITH head AS (SELECT max(event_id) + 1 AS l FROM events),
readers AS (SELECT user_id, max(event_id) + 1 + max(event_id) % 50 * 10 AS last_seq FROM events GROUP BY user_id)
SELECT user_id, last_seq, CASE WHEN last_seq + 1 < l // 2 THEN 'too_old' WHEN last_seq > l THEN 'log_was_reset' ELSE 'resume' END AS state
FROM readers, head"""

ORACLE["cleaned_history"] = """
SELECT CAST(i AS BIGINT) AS cursor, CASE WHEN i < 3 THEN 'removed' ELSE 'resume' END AS state, CAST(CASE WHEN i >= 3 THEN i END AS BIGINT) AS reads_after
FROM (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region)"""

ORACLE["capture_latency"] = f"""
WITH {_CAPTURED} SELECT CAST(table_id AS BIGINT) AS table_id, count(*) AS events, count(*) AS not_early, TRUE AS ascending
FROM captured WHERE type = 'change' GROUP BY table_id"""

ORACLE["log_size"] = """
WITH n AS (SELECT max(event_id) + 1 AS top, count(*) AS rows FROM events),
b AS (SELECT CASE WHEN event_id + 1 <= top // 3 THEN 1 WHEN event_id + 1 <= 2 * top // 3 THEN 2 ELSE 3 END AS batch, count(*) AS k FROM events, n GROUP BY 1),
s AS (SELECT batch, k, sum(k) OVER (ORDER BY batch DESC) AS kept FROM b)
SELECT 'whole' AS part, 3 AS batches, sum(k) AS rows, TRUE AS has_bytes FROM b
UNION ALL SELECT 'kept', count(*), sum(k), TRUE FROM s, n WHERE kept <= rows // 2 OR batch = 3"""
