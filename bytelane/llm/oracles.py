"""DuckDB SQL of the subpackage's queries, for those that SQL can express."""

from __future__ import annotations

from bytelane.llm import chat, secrets

def _escaped(c: str) -> str:
    return rf"regexp_replace({c}, '([<\[])(\\*)({chat.TAILS})', '\1\\\2\3', 'g')"


OP1 = rf"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS seq,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {chat.MARKS_PER_TURN} AS n,
    length({_escaped('role')}) + length({_escaped('text')}) + {len(chat.TURN + chat.TEXT + chat.END)} AS chars
  FROM rows_),
led AS (SELECT *, seq = 1 AND role = 'system' AS lead FROM numbered),
sums AS (
  SELECT *, sum(CASE WHEN lead THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY seq) AS b,
    greatest({chat.BUDGET - chat.HISTORY} - coalesce(max(CASE WHEN lead THEN n END) OVER (PARTITION BY conv_id), 0), 1) AS room,
    coalesce(max(CASE WHEN lead THEN chars END) OVER (PARTITION BY conv_id), 0) AS system_chars
  FROM led),
placed AS (
  SELECT *, b - n AS a, CASE WHEN lead THEN -1 ELSE 2 * ((b - n) // room) + CASE WHEN (b - n) // room < (b - 1) // room THEN 1 ELSE 0 END END AS win
  FROM sums),
wins AS (
  SELECT conv_id, win, min(a) AS a, sum(chars) + max(system_chars) AS chars FROM placed WHERE NOT lead GROUP BY ALL),
past AS (
  SELECT w.conv_id, w.win, sum(p.chars) AS chars FROM wins w JOIN placed p
    ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND NOT p.lead AND p.a >= w.a - {chat.HISTORY} AND p.a < w.a
  GROUP BY ALL),
formatted AS (
  SELECT conv_id, sum(chars) AS chars FROM (
    SELECT conv_id, chars FROM wins UNION ALL SELECT conv_id, chars FROM past
    UNION ALL SELECT conv_id, max(chars) FROM placed GROUP BY conv_id HAVING bool_and(lead)) GROUP BY conv_id)
SELECT n.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '')) AS loss_sha256,
  any_value(f.chars)::BIGINT AS formatted_chars
FROM numbered n JOIN formatted f ON f.conv_id IS NOT DISTINCT FROM n.conv_id
GROUP BY n.conv_id
"""


def _secret_kind(number: int, rule: secrets.Rule) -> str:
    pattern = (rule.sql or rule.pattern).replace("'", "''")
    return rf"""
  SELECT rid, {number} AS kind, stop - length(m) AS start, stop FROM (
    SELECT rid, m, v, sum(length(m) + length(g)) OVER (PARTITION BY rid ORDER BY i) AS stop FROM (
      SELECT rid, unnest(ms) AS m, unnest(vs) AS v, unnest(gs) AS g, unnest(range(len(ms))) AS i FROM (
        SELECT rid, regexp_extract_all(text, '{pattern}') AS ms,
          regexp_extract_all(text, '{pattern}', {rule.value_group}) AS vs,
          string_split_regex(text, '{pattern}')[1:len(regexp_extract_all(text, '{pattern}'))] AS gs
        FROM d)))
  WHERE length(v) >= {rule.value_chars}"""


def _secret_names() -> str:
    return "[" + ", ".join(f"'{r.kind}'" for r in secrets.RULES) + "]"


OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({' UNION ALL '.join(_secret_kind(i, r) for i, r in enumerate(secrets.RULES))}),
named AS (SELECT *, {_secret_names()}[kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS s FROM spans)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < {sum(r.base for r in secrets.RULES)}), '')) AS base_sha256,
  coalesce(string_agg(s, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN named ON d.rid = named.rid
GROUP BY d.rid, d.doc_id
"""

OP9 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT row_number() OVER () AS bid, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON bw.k = dw.k AND bw.n = dw.n),
words AS (SELECT rid, count(*) AS n_hit FROM (
  SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (
  SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
tf AS (SELECT rid, doc_id, t, count(*) AS tf FROM (SELECT rid, doc_id, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
s AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
q AS (
  SELECT DISTINCT doc_id AS query_id, t FROM tf
  WHERE doc_id % 50 = 0),
scored AS (
  SELECT q.query_id, tf.rid, any_value(tf.doc_id) AS doc_id,
    round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d.w) / mean))), 6) AS score
  FROM q JOIN tf USING (t) JOIN df USING (t) JOIN d ON d.rid = tf.rid, s GROUP BY q.query_id, tf.rid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
df AS (SELECT t, floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, s GROUP BY t),
q AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(min(coalesce(text, '')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t
    FROM benchmark GROUP BY item_id) GROUP BY ALL),
sizes AS (SELECT rid, doc_id, 100 - 25 + ((25 * len(w)::BIGINT * s.n) // s.l) AS m FROM d, s WHERE len(w) > 0),
scored AS (
  SELECT q.item_id, tf.rid, any_value(z.doc_id) AS doc_id,
    sum(q.times * df.weight * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * z.m)))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN df USING (t) JOIN sizes z ON z.rid = tf.rid
  GROUP BY q.item_id, tf.rid)
SELECT * FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
WHERE rank <= 20
"""

OP13 = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings),
pairs AS (
  SELECT a.rid AS a, b.rid AS b, CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END AS c
  FROM v a JOIN v b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE a.usable AND b.usable),
links AS (SELECT a, b FROM pairs WHERE c >= 0.93),
reach AS (SELECT rid AS a, rid AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT r.a, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.rid = r.b GROUP BY r.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.rid) AS n_links, least.component_id,
  v.vec_id IS NOT DISTINCT FROM least.component_id AS kept
FROM v JOIN least ON least.a = v.rid
"""

ORACLES = {
    "op1_chat_format": OP1,
    "op4_secret_scan": OP4,
    "op8_bm25_top_k": OP8,
    "op9_decontaminate": OP9,
    "op12_ranked_search": OP12,
    "op13_embedding_dedup": OP13,
}
