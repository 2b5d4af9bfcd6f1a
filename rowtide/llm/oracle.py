"""The same results in DuckDB's SQL, where SQL can express them."""

WORD = r"[^\x20\x09-\x0D]+"

OP2 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
             max(page_id) OVER (PARTITION BY html) AS keeper FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND keeper IS DISTINCT FROM page_id AND keeper IS NOT NULL AS again FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN keeper END AS refers_to
FROM r
"""

OP7 = """
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS UBIGINT) AS BIGINT) AS hash
  FROM documents),
e AS (SELECT *, hash >> (60 - depth) AS prefix FROM d, (SELECT unnest(range(0, 31)) AS depth)),
s AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM e GROUP BY depth, prefix),
l AS (SELECT e.doc_id, min(e.depth) AS depth FROM e JOIN s USING (depth, prefix) WHERE s.bytes <= 2097152 GROUP BY e.doc_id)
SELECT doc_id, n_bytes, right(lpad(bin(prefix), 60, '0'), CAST(depth AS INTEGER)) AS shard, CAST(depth AS INTEGER) AS depth,
       s.bytes AS shard_bytes
FROM e JOIN l USING (doc_id, depth) JOIN s USING (depth, prefix)
"""

OP8 = """
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w,
             2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / w, coalesce('=' || source, 'null')
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS given,
             sum(w) OVER (ORDER BY cap / w, coalesce('=' || source, 'null')
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM w),
f AS (SELECT *, (total - given) * w >= cap * left_w AS is_full FROM o),
g AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0.0 END) OVER () AS used,
             sum(CASE WHEN is_full THEN 0.0 ELSE w END) OVER () AS free_w FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE w * (total - used) / free_w END AS target FROM g),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2 AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (CAST(target >= middle AS INTEGER) + CAST(target - source_size >= middle AS INTEGER)) AS BIGINT) AS taken
FROM m
"""

OP10 = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
k AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common
      FROM (SELECT * FROM g SEMI JOIN k USING (s)) a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * common >= 85 * (x.n + y.n - common)),
l AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
z AS (SELECT u AS doc_id, min(v) AS low FROM r GROUP BY u)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce(z.low, t.doc_id)) AS component_id,
       t.doc_id = least(t.doc_id, coalesce(z.low, t.doc_id)) AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN z USING (doc_id)
"""

def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8 bytes, a bit at a time."""
    digits = f"hex(encode({text}))"
    bytes_ = f"list_transform(range(1, length({digits}), 2), lambda p: CAST('0x' || substr({digits}, p, 2) AS BIGINT))"
    eight = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: {eight}), 4294967295)"


OP11 = f"""
WITH RECURSIVE t AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS id, unnest(regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
r AS (SELECT id, run, count(*) AS n FROM t WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, {_crc32("id || ':' || run")} AS h FROM r),
g AS (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM g WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT *, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.rest = v.word
      UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.rest = v.word),
b AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS best, max(near_n) AS best_n FROM e GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form,
             CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM f JOIN c USING (word) JOIN f AS z ON z.word = c.root WHERE z.form IS NULL
"""


def _leaf(text: str) -> str:
    def field(value: str) -> str:
        return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || {value}, '-')"

    return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUN = "list(h ORDER BY i) AS kids, sha256(string_agg(h, '' ORDER BY i)) AS h"

OP13 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, {_leaf('text')} AS leaf,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf(_LOWERED)} END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d),
p AS (SELECT 1 AS level, k, i // 16 AS i, any_value((n + 15) // 16) AS n, {_RUN.replace('h ORDER', 'leaf ORDER').replace('string_agg(h', 'string_agg(leaf')}
      FROM l WHERE n > 1 GROUP BY k, i // 16
      UNION ALL SELECT any_value(level) + 1, k, i // 16, any_value((n + 15) // 16), {_RUN} FROM p WHERE n > 1 GROUP BY k, i // 16),
t AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n
      FROM (SELECT k, h FROM p WHERE n = 1 UNION ALL SELECT k, leaf FROM l WHERE n = 1)),
q AS (SELECT 1 AS level, i // 16 AS i, any_value((n + 15) // 16) AS n, {_RUN} FROM t WHERE n > 1 GROUP BY i // 16
      UNION ALL SELECT any_value(level) + 1, i // 16, any_value((n + 15) // 16), {_RUN} FROM q WHERE n > 1 GROUP BY i // 16),
u AS (SELECT row_number() OVER () AS rid, doc_id, k, leaf, coalesce(changed, leaf) AS now_h, i, n FROM l),
w AS (SELECT rid, k, now_h, i, n, 0 AS level, '' AS proof FROM u
      UNION ALL
      SELECT w.rid, w.k, sha256(array_to_string(p.kids[:w.i % 16], '') || w.now_h || array_to_string(p.kids[w.i % 16 + 2:], '')),
             p.i, p.n, p.level, w.proof || array_to_string(p.kids[:w.i % 16], '') || array_to_string(p.kids[w.i % 16 + 2:], '')
      FROM w JOIN p ON p.k = w.k AND p.level = w.level + 1 AND p.i = w.i // 16),
y AS (SELECT w.rid, t.h AS subroot, w.now_h, t.i, 0 AS level, w.proof, t.n FROM w JOIN t USING (k) WHERE w.n = 1
      UNION ALL
      SELECT y.rid, y.subroot, sha256(array_to_string(q.kids[:y.i % 16], '') || y.now_h || array_to_string(q.kids[y.i % 16 + 2:], '')),
             q.i, q.level, y.proof || array_to_string(q.kids[:y.i % 16], '') || array_to_string(q.kids[y.i % 16 + 2:], ''), q.n
      FROM y JOIN q ON q.level = y.level + 1 AND q.i = y.i // 16),
z AS (SELECT h AS root FROM q WHERE n = 1 UNION ALL SELECT h FROM t WHERE n = 1)
SELECT u.doc_id, u.leaf, y.subroot, z.root, sha256(y.proof) AS proof_sha256, y.now_h AS folded_root, y.now_h = z.root AS verified
FROM y JOIN u USING (rid) CROSS JOIN z WHERE y.n = 1
"""

ORACLE: dict[str, str] = {
    "op2_warc": OP2,
    "op7_shards": OP7,
    "op8_mix": OP8,
    "op10_minhash": OP10,
    "op11_spelling": OP11,
    "op13_manifest": OP13,
}
