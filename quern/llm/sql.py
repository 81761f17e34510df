"""SQL twins (DuckDB) of the pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

P1_FOUND = r"""
WITH latest AS (
  SELECT parent_id, chunk_index, arg_max(struct_pack(t := text, c := coalesce(continued, false)), (rev, chunk_id)) AS r
  FROM memory_chunks GROUP BY ALL),
ready AS (SELECT parent_id, chunk_index, r.c AS c, trim(replace(coalesce(r.t, ''), chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM latest)
SELECT parent_id, chunk_index FROM ready
WHERE length(CASE WHEN NOT c THEN t WHEN instr(t, chr(10)) = 0 THEN '' ELSE substr(t, instr(t, chr(10)) + 1) END) > 1200
"""

P2_FOUND = r"""
WITH RECURSIVE rows AS (
  SELECT least(memory_a, memory_b) AS a, greatest(memory_a, memory_b) AS b, upper(trim(verdict, ' ' || chr(9) || chr(10) || chr(13))) AS v, judged_at, verdict_id FROM verdicts),
last AS (SELECT a, b, arg_max(v, (judged_at, verdict_id)) AS v FROM rows WHERE v <> 'UNSURE' AND v <> '' GROUP BY a, b),
links AS (SELECT a AS x, b AS y FROM last WHERE v = 'MERGE' UNION SELECT b, a FROM last WHERE v = 'MERGE'),
reach AS (SELECT x AS node, x AS hit FROM links UNION SELECT r.node, l.y FROM reach r JOIN links l ON l.x = r.hit),
comp AS (SELECT node AS memory_id, min(hit) AS group_id FROM reach GROUP BY node),
m AS (SELECT memory_id, arg_max(struct_pack(n := name, d := description, c := category, l := labels), rev) AS r FROM memories GROUP BY memory_id),
c AS (SELECT memory_id, arg_max(struct_pack(u := last_used_at, p := use_pos), folded_event_id) AS r FROM counts GROUP BY memory_id),
v AS (
  SELECT comp.group_id, comp.memory_id,
    (trim(coalesce(m.r.n, '')) <> '')::INT + (trim(coalesce(m.r.d, '')) <> '')::INT + (trim(coalesce(m.r.c, '')) <> '')::INT + (trim(coalesce(m.r.l, '')) NOT IN ('', '[]'))::INT AS f,
    coalesce(epoch_us(c.r.u), -1) AS u, coalesce(c.r.p, -1) AS p
  FROM comp LEFT JOIN m USING (memory_id) LEFT JOIN c USING (memory_id))
SELECT group_id, memory_id AS survivor_id FROM v
WHERE NOT EXISTS (SELECT 1 FROM v w WHERE w.group_id = v.group_id AND (w.f > v.f OR w.u > v.u OR w.p > v.p))
"""

P2_SURVIVORS = r"""
WITH RECURSIVE rows AS (
  SELECT least(memory_a, memory_b) AS a, greatest(memory_a, memory_b) AS b, upper(trim(verdict, ' ' || chr(9) || chr(10) || chr(13))) AS v, judged_at, verdict_id, reason,
    CASE upper(trim(survivor, ' ' || chr(9) || chr(10) || chr(13))) WHEN 'A' THEN memory_a WHEN 'B' THEN memory_b END AS voted FROM verdicts),
last AS (SELECT a, b, arg_max(struct_pack(v := v, voted := voted, reason := reason), (judged_at, verdict_id)) AS r FROM rows WHERE v <> 'UNSURE' AND v <> '' GROUP BY a, b),
ties AS (SELECT a, b, r.voted AS voted, r.reason AS reason FROM last WHERE r.v = 'MERGE'),
votes AS (SELECT voted AS memory_id, count(*) AS votes, min(reason) AS vote_reason FROM ties WHERE voted IS NOT NULL GROUP BY voted),
links AS (SELECT a AS x, b AS y FROM ties UNION SELECT b, a FROM ties),
reach AS (SELECT x AS node, x AS hit FROM links UNION SELECT r.node, l.y FROM reach r JOIN links l ON l.x = r.hit),
comp AS (SELECT node AS memory_id, min(hit) AS group_id FROM reach GROUP BY node),
m AS (SELECT memory_id, arg_max(struct_pack(n := name, d := description, c := category, l := labels), rev) AS r FROM memories GROUP BY memory_id),
c AS (SELECT memory_id, arg_max(struct_pack(u := last_used_at, p := use_pos), folded_event_id) AS r FROM counts GROUP BY memory_id),
v AS MATERIALIZED (
  SELECT comp.group_id, comp.memory_id, CASE WHEN trim(m.r.n) <> '' THEN m.r.n END AS name, CASE WHEN trim(m.r.d) <> '' THEN m.r.d END AS description, CASE WHEN trim(m.r.c) <> '' THEN m.r.c END AS category,
    CASE WHEN trim(m.r.l) NOT IN ('', '[]') THEN m.r.l END AS labels, c.r.u AS last_used_at, vote_reason, coalesce(votes, 0) AS votes,
    (name IS NOT NULL)::INT + (description IS NOT NULL)::INT + (category IS NOT NULL)::INT + (labels IS NOT NULL)::INT AS f, coalesce(epoch_us(c.r.u), -1) AS u, coalesce(c.r.p, -1) AS p
  FROM comp LEFT JOIN m USING (memory_id) LEFT JOIN c USING (memory_id) LEFT JOIN votes USING (memory_id)),
lay AS (
  SELECT group_id, memory_id, 1 AS k FROM v
  UNION SELECT w.group_id, w.memory_id, lay.k + 1 FROM lay JOIN v b ON b.memory_id = lay.memory_id JOIN v w ON w.group_id = b.group_id AND b.f >= w.f AND b.u >= w.u AND b.p >= w.p AND (b.f, b.u, b.p) <> (w.f, w.u, w.p)),
x AS (SELECT v.*, k, (-k, f, u, p, votes, -v.memory_id) AS best FROM v JOIN (SELECT memory_id, max(k) AS k FROM lay GROUP BY memory_id) USING (memory_id))
SELECT group_id, arg_max(memory_id, best) AS survivor_id, arg_max(name, best) FILTER (name IS NOT NULL) AS name, arg_max(description, best) FILTER (description IS NOT NULL) AS description,
  arg_max(category, best) FILTER (category IS NOT NULL) AS category, arg_max(labels, best) FILTER (labels IS NOT NULL) AS labels, arg_max(last_used_at, best) FILTER (last_used_at IS NOT NULL) AS last_used_at,
  count(*) AS group_size, arg_max(struct_pack(r := vote_reason), best).r AS reason, count(*) FILTER (k = 1) AS undominated,
  greatest(1, arg_max(k, best) FILTER (name IS NOT NULL), arg_max(k, best) FILTER (description IS NOT NULL), arg_max(k, best) FILTER (category IS NOT NULL), arg_max(k, best) FILTER (labels IS NOT NULL), arg_max(k, best) FILTER (last_used_at IS NOT NULL))::INT AS layers
FROM x GROUP BY group_id
"""

P3_TEXTS = r"""t AS (
  SELECT memory_id AS id, regexp_extract_all(lower(coalesce(r.d, '') || ' ' || coalesce(r.b, '')), '[\p{L}\p{N}]+') AS w
  FROM (SELECT memory_id, arg_max(struct_pack(d := description, b := body), rev) AS r FROM memories GROUP BY memory_id)),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM t WHERE len(w) >= 3),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
near AS (SELECT a, b FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE c >= 0.5 * (na.n + nb.n - c))"""
P3_FOUND = f"WITH {P3_TEXTS} SELECT a AS memory_a, b AS memory_b FROM near"

P3_GROUPS = f"""WITH RECURSIVE {P3_TEXTS},
c AS (SELECT id, min(id) OVER (PARTITION BY w) AS rep, count(*) OVER (PARTITION BY w) AS copies FROM t WHERE len(w) >= 3),
l AS (SELECT a, b FROM near WHERE a IN (SELECT rep FROM c) AND b IN (SELECT rep FROM c)),
deg AS (SELECT rep, count(*) AS links FROM (SELECT a AS rep FROM l UNION ALL SELECT b FROM l) GROUP BY rep),
e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
reach AS (SELECT x AS node, x AS hit FROM e UNION SELECT r.node, e.y FROM reach r JOIN e ON e.x = r.hit),
comp AS (SELECT node AS rep, min(hit) AS group_id FROM reach GROUP BY node)
SELECT c.id AS memory_id, coalesce(group_id, c.rep) AS group_id, c.rep, coalesce(links, 0) AS links, copies FROM c LEFT JOIN comp USING (rep) LEFT JOIN deg USING (rep) WHERE links IS NOT NULL OR copies > 1"""

P4_FOUND = r"""
WITH one AS (SELECT *, row_number() OVER (PARTITION BY transcript, line_no ORDER BY row_id) AS n FROM calls),
t AS (
  SELECT *, last_value(CASE WHEN moment > 1e11 THEN moment / 1000 ELSE moment END IGNORE NULLS) OVER (PARTITION BY transcript ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS ts_,
    lower(trim(session, ' ' || chr(9) || chr(10) || chr(13))) AS s FROM one WHERE n = 1),
main AS (
  SELECT s, ts_, line_no, transcript, tool_use_id,
    role = 'user' AND NOT coalesce(is_meta, false) AND regexp_matches(coalesce(prompt, ''), '[\p{L}\p{N}]') AS p,
    role = 'assistant' AND regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]') AS r,
    trim(coalesce(tool, '')) <> '' AS is_call, trim(coalesce(tool, '')) = '' AND (role = 'tool' OR tool_use_id IS NOT NULL) AS is_result
  FROM t WHERE agent = 'main'),
talk AS (SELECT s, p, row_number() OVER w AS i, lead(p) OVER w AS nxt FROM main WHERE p OR r WINDOW w AS (PARTITION BY s ORDER BY ts_ NULLS FIRST, line_no, transcript)),
bad AS (
  SELECT s FROM talk WHERE (i = 1 AND NOT p) OR (p AND coalesce(nxt, true))
  UNION SELECT s FROM main WHERE (is_call OR is_result) AND tool_use_id IS NULL
  UNION SELECT s FROM (
    SELECT s, tool_use_id, min(CASE WHEN is_call THEN (ts_, line_no, transcript) END) AS c, min(CASE WHEN is_result THEN (ts_, line_no, transcript) END) AS r
    FROM main WHERE (is_call OR is_result) AND tool_use_id IS NOT NULL GROUP BY ALL) WHERE c IS NULL OR r IS NULL OR c >= r)
SELECT s AS session FROM bad
UNION SELECT s FROM t WHERE s <> '' AND s NOT IN (SELECT s FROM main WHERE p)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_survivors": P2_SURVIVORS, "p3_found": P3_FOUND, "p3_groups": P3_GROUPS, "p4_found": P4_FOUND}
