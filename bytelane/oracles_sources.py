"""Independent SQL (DuckDB dialect) for the queries in `catalog_sources.py`."""

from __future__ import annotations

from bytelane import catalog as C
from bytelane import catalog_sources as S
from bytelane import oracles as O

FILES = """files AS (
  SELECT string_agg(hex(encode(coalesce(text, '') || chr(10))), '' ORDER BY doc_id) AS h,
         sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS t
  FROM documents)"""

BOOKS = f"""WITH books AS (
  SELECT doc_id // {S.BOOK} AS book, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY book)"""

SAMPLES = f"""
WITH {FILES}
SELECT r.j::BIGINT AS idx, least({S.SAMPLE_BYTES}, t - r.j * {S.SAMPLE_BYTES})::BIGINT AS n_bytes,
       md5(unhex(substr(h, 2 * r.j * {S.SAMPLE_BYTES} + 1, 2 * {S.SAMPLE_BYTES}))) AS md5
FROM files, range(0, (t + {S.SAMPLE_BYTES} - 1) // {S.SAMPLE_BYTES}) r(j)"""


_ROW = C.IMG["width"] * C.IMG["channels"]


def _weights(name: str, sizes: str, n_out: int) -> str:
    """CTEs of integer resampling weights `(n, o, i, k)` from n to `n_out` pixels."""
    sinc = lambda x: f"(CASE WHEN {x} = 0 THEN 1.0 ELSE sin({x} * pi()) / ({x} * pi()) END)"
    return f"""
{name}_o AS (
  SELECT n, o, greatest(n / {n_out}.0::DOUBLE, 1) AS fs, (o + 0.5) * (n / {n_out}.0::DOUBLE) AS c
  FROM ({sizes}), range(0, {n_out}) r(o)),
{name}_x AS (
  SELECT n, o, j AS i, (j - c + 0.5) * (1.0 / fs) AS x
  FROM {name}_o, range(greatest(trunc(c - 3 * fs + 0.5), 0)::BIGINT, least(trunc(c + 3 * fs + 0.5), n)::BIGINT) r(j)),
{name}_w AS (SELECT n, o, i, CASE WHEN x >= -3 AND x < 3 THEN {sinc('x')} * {sinc('(x / 3)')} ELSE 0.0 END AS w FROM {name}_x),
{name} AS (
  SELECT n, o, i, trunc(k * 4194304 + CASE WHEN k < 0 THEN -0.5 ELSE 0.5 END)::BIGINT AS k
  FROM (SELECT n, o, i, w / sum(w) OVER (PARTITION BY n, o) AS k FROM {name}_w))"""


def _resize_sql() -> str:
    """Pixel by pixel: weights as integers, a horizontal pass, a vertical pass, a byte after each."""
    width, channels = C.IMG["width"], C.IMG["channels"]
    row = width * channels
    out_w, out_h = S.RESIZED
    byte = lambda s: f"greatest(least(({s} + 2097152) // 4194304, 255), 0)"
    return f"""
WITH d AS (
  SELECT doc_id AS image_id, octet_length(encode(text)) AS n, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b
  FROM documents),
im AS (SELECT image_id, (n + {row - 1}) // {row} AS h, b FROM d WHERE n > 0),
{_weights('hw', f'SELECT {width} AS n', out_w)},
{_weights('vw', 'SELECT DISTINCT h AS n FROM im', out_h)},
px AS (
  SELECT image_id, h, (p // {row})::BIGINT AS y, (p % {row}) // {channels} AS x, p % {channels} AS ch, coalesce(b[p + 1], 0) AS v
  FROM (SELECT image_id, h, b, unnest(range(0, h * {row})) AS p FROM im)),
hp AS (SELECT image_id, h, y, ch, o AS x, {byte('sum(v * k)::BIGINT')} AS v FROM px JOIN hw ON hw.i = px.x GROUP BY image_id, h, y, ch, o),
vp AS (SELECT image_id, x, ch, o AS y, {byte('sum(v * k)::BIGINT')} AS v FROM hp JOIN vw ON vw.n = hp.h AND vw.i = hp.y GROUP BY image_id, x, ch, o)
SELECT image_id, md5(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY y, x, ch)) AS data_md5 FROM vp GROUP BY image_id"""


ORACLES = {
    "file_ranges": f"""
WITH {FILES}
SELECT 0::BIGINT AS worker, r.j::BIGINT AS idx, (r.j * {C.FLAGSHIP_L})::BIGINT AS start, {C.FLAGSHIP_L}::BIGINT AS n_bytes,
       md5(unhex(substr(h, 2 * r.j * {C.FLAGSHIP_L} + 1, 2 * {C.FLAGSHIP_L}))) AS md5
FROM files, range(0, t // {C.FLAGSHIP_L}) r(j)""",
    "question_ranges": """
SELECT row_number() OVER (ORDER BY q.conv_id, q.turn) - 1 AS idx, q.conv_id, q.turn, 'i' || q.conv_id AS image_filename, 'exists' AS kind,
       q.text AS question, a.text AS answer
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
WHERE q.role = 'user'""",
    "sample_items": SAMPLES,
    "sample_stream": SAMPLES,
    "append_log": f"""
WITH {O.LOG_CTE}
SELECT CASE WHEN gpu_rank % 2 = 0 THEN 'even' ELSE 'odd' END AS commit, run, gpu_rank::BIGINT AS gpu_rank, kind, cum_batch, timestamp,
       round(loss, 6)::DECIMAL(24,6) AS loss
FROM lg""",
    "live_undo": O.ORACLES["jsonl_undo"],
    "random_stream": f"""
WITH {FILES},
s AS (SELECT r.i AS draw, ('0x' || substr(md5(concat_ws('|', {C.RANDOM['seed']}, r.i)), 1, 15))::BIGINT % (t - {C.RANDOM['L']}) AS start, h
      FROM files, range(0, {C.RANDOM['k']}) r(i))
SELECT draw::BIGINT AS draw, start::BIGINT AS start, {C.RANDOM['L']}::BIGINT AS n_bytes,
       md5(unhex(substr(h, 2 * start + 1, 2 * {C.RANDOM['L']}))) AS md5 FROM s""",
    "dense_corpus": f"""
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, dense_rank() OVER (ORDER BY l_partkey) - 1 + {C.IMG['remap_start']} AS code
FROM lineitem""",
    "mapped_state": f"""
WITH tgt AS (SELECT 'layer' || (vec_id % {C.STATE_KEYS}) AS key, vec_id // {C.STATE_KEYS} AS row FROM embeddings),
src AS (SELECT key, row - {C.STATE_SHIFT} AS row FROM tgt WHERE row >= {C.STATE_SHIFT}),
m AS (SELECT t.key, s.key IS NOT NULL AND t.key IN ('layer0', 'layer2') AS taken FROM tgt t LEFT JOIN src s USING (key, row))
SELECT what, n::BIGINT AS n FROM (
  SELECT count(*) AS rows, count(*) FILTER (key IN ('layer0', 'layer1')) AS renamed, count(*) FILTER (taken) AS extended, count(*) FILTER (NOT taken) AS kept FROM m)
UNPIVOT (n FOR what IN (rows, renamed, extended, kept))""",
    "parsed_lines": f"""
SELECT CASE WHEN event_id % {S.BROKEN_EVERY} <> 0 THEN event_id END AS event_id, CASE WHEN event_id % {S.BROKEN_EVERY} <> 0 THEN user_id END AS user_id,
       CASE WHEN event_id % {S.BROKEN_EVERY} <> 0 THEN event_type END AS event_type,
       CASE WHEN event_id % {S.BROKEN_EVERY} = 0 THEN left('{{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}}', 25) END AS text,
       CASE WHEN event_id % {S.BROKEN_EVERY} = 0 THEN 'JSONDecodeError' END AS error
FROM events""",
    "resize": _resize_sql(),
    "image_files": f"""
WITH d AS (
  SELECT doc_id AS image_id, (octet_length(encode(text)) + {_ROW - 1}) // {_ROW} AS h, regexp_extract_all(hex(encode(text)) || repeat('00', {_ROW}), '..') AS x
  FROM documents WHERE octet_length(encode(text)) > 0)
SELECT image_id, h::BIGINT AS height, {C.IMG['width']}::BIGINT AS width,
       md5(array_to_string(list_transform(range(0, h * {_ROW}), lambda i: x[(i // 3) * 3 + 3 - i % 3]), '')) AS bgr_md5
FROM d""",
    "books": f"""
{BOOKS}
SELECT row_number() OVER (ORDER BY book) - 1 AS doc_id, octet_length(encode(t))::BIGINT AS n_bytes, md5(t) AS md5 FROM books""",
    "book_texts": f"""
{BOOKS}
SELECT row_number() OVER (ORDER BY book) - 1 AS doc_id, length(t)::BIGINT AS n_chars, md5(t) AS md5 FROM books""",
    "masked_books": O._masked_sql(FILES.replace("files AS", "corpus AS"), 0),
    "typed_lines": "SELECT event_id, user_id, event_type, round(value, 6)::DECIMAL(24,6) AS value FROM events",
    "artefacts": """
SELECT user_id AS run, count(*) AS n_checkpoints, true AS has_loss_csv, user_id % 3 > 0 AS has_config, true AS has_train_log, user_id % 2 = 0 AS checkpoints_ok
FROM events WHERE event_type = 'purchase' GROUP BY user_id""",
}
