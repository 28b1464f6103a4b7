"""DuckDB statements of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

OP8 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""


OP9 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


OP7 = r"""
WITH u AS (
  SELECT conv_id, turn, coalesce(text, '') AS q, len(string_split(coalesce(text, ''), ' ')) AS n,
         ['plain', 'formal', 'loud'][turn % 3 + 1] AS tone
  FROM conversations WHERE role = 'user'),
c AS (
  SELECT conv_id, turn, 'lookup' AS tool, 0 AS level, json_object('query', q)::VARCHAR AS arguments,
         CASE WHEN length(q) < 1 THEN '$.query: too short' WHEN length(q) > 200 THEN '$.query: too long' END AS problem
  FROM u UNION ALL
  SELECT conv_id, turn, 'draft', 1, json_object('words', n)::VARCHAR,
         CASE WHEN n < 1 THEN '$.words: below minimum' WHEN n > 30 THEN '$.words: above maximum' END FROM u UNION ALL
  SELECT conv_id, turn, 'answer', 2, json_object('after', turn, 'tone', tone)::VARCHAR,
         CASE WHEN turn < 0 THEN '$.after: below minimum' WHEN tone = 'loud' THEN '$.tone: not in enum' END FROM u),
k AS (
  SELECT *, concat_ws('-', conv_id, turn, tool) AS call_id,
         row_number() OVER (PARTITION BY conv_id, turn, tool ORDER BY arguments) AS nth FROM c),
r AS (
  SELECT conv_id, turn, concat_ws('-', conv_id, turn - 1, 'answer') AS call_id, text AS content
  FROM conversations WHERE role = 'assistant'),
a AS (SELECT conv_id, call_id, min(content) AS content FROM r GROUP BY ALL),
j AS (
  SELECT k.*, a.content, CASE WHEN nth > 1 THEN 'repeated' WHEN a.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status
  FROM k LEFT JOIN a ON a.conv_id = k.conv_id AND a.call_id = k.call_id),
x AS (SELECT DISTINCT conv_id, turn FROM u)
SELECT conv_id, turn, 'message' AS kind, NULL::INTEGER AS level, NULL::VARCHAR AS call_id, NULL::VARCHAR AS status,
       NULL::BOOLEAN AS valid, NULL::VARCHAR AS problem, NULL::BIGINT AS unmet,
       json_object('content', coalesce(text, ''), 'role', coalesce(role, ''))::VARCHAR AS json
FROM conversations
UNION ALL
SELECT j.conv_id, j.turn, 'call', level, call_id, status, problem IS NULL, problem,
       (tool = 'answer' AND j.turn >= 2 AND x.turn IS NULL)::BIGINT,
       '{"arguments":' || arguments || ',' || (json_object(
         'call_id', call_id, 'result', CASE WHEN status = 'linked' THEN coalesce(content, '') ELSE '' END, 'role', 'call',
         'status', status, 'tool', tool, 'valid', problem IS NULL)::VARCHAR)[2:]
FROM j LEFT JOIN x ON x.conv_id = j.conv_id AND x.turn = j.turn - 2
UNION ALL
SELECT r.conv_id, r.turn, 'orphan', NULL, call_id, 'orphan', NULL, NULL, NULL,
       json_object('call_id', call_id, 'content', coalesce(content, ''), 'role', 'tool')::VARCHAR
FROM r LEFT JOIN x ON x.conv_id = r.conv_id AND x.turn = r.turn - 1 WHERE x.turn IS NULL
"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11 = rf"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM d GROUP BY 1),
t AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM n),
f AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY 1, 2),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM f, t GROUP BY term),
q AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (
  SELECT item_id, f.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // l))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN n USING (doc_id), t GROUP BY 1, 2),
r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""


def _op12(rounds: int = 3) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
p{i} AS (
  SELECT v.no, v.vec_id, v.x, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM v, c{i} c),
a{i} AS (SELECT no, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(k, (d, k)) AS k, min(d) AS d FROM p{i} GROUP BY no)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (
  SELECT k, list(s ORDER BY j) AS x FROM (
    SELECT k, j, floor(sum(e)::DOUBLE / count(*))::BIGINT AS s
    FROM (SELECT k, unnest(x) AS e, generate_subscripts(x, 1) AS j FROM a{i}) GROUP BY k, j) GROUP BY k),
c{i + 1} AS (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (
  SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS k, x
  FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 16)),{",".join(steps)}
SELECT vec_id, a.k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k
"""


OP13 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + 9], ' ') AS line
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT size FROM p),
o AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS line
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, z)),
h AS (SELECT o.doc_id, o.i, o.size, p.item_id FROM o JOIN p ON p.line = o.line AND p.size = o.size),
n AS (
  SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM (SELECT DISTINCT doc_id, i, size FROM h)) GROUP BY 1),
k AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def oracle() -> dict[str, str]:
    return {
        "op7_tool_call_chats": OP7, "op8_heavy_hitter_dedup": OP8, "op9_maxscore_top5": OP9, "op11_nra_ranked_search": OP11,
        "op12_pivot_clusters": _op12(), "op13_benchmark_automaton": OP13,
    }
