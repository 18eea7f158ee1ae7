"""Independent SQL (DuckDB dialect) for each registered query in `catalog.py`.

The oracle side builds the concatenated corpus as one hex string, which is
the plain single-machine reading of the operator, and cuts windows out of it.
"""

from __future__ import annotations

from bytelane import catalog as C
from bytelane.operators.qa import ANSWER_CLASS_MAP, QUESTION_TYPES

CORPUS = """corpus AS (
  SELECT string_agg(hex(encode(text)), '' ORDER BY doc_id) AS h,
         sum(octet_length(encode(text)))::BIGINT AS t
  FROM documents)"""


def _windows_sql(L: int, workers: int, epoch: int, tail: bool) -> str:
    off = epoch % L
    extra = 1 if tail else 0
    return f"""
WITH {CORPUS},
spec AS (SELECT h, t, t // {workers} AS s, greatest((t // {workers} - {off}) // {L}, 0) AS cnt FROM corpus),
w AS (
  SELECT h, t, wk.w AS worker, r.j AS idx, wk.w * s + {off} + r.j * {L} AS start
  FROM spec, range(0, {workers}) wk(w), range(0, spec.cnt + {extra}) r(j))
SELECT worker::BIGINT AS worker, idx::BIGINT AS idx, start::BIGINT AS start,
       least({L}, t - start)::BIGINT AS n_bytes,
       md5(unhex(substr(h, 2 * start + 1, 2 * least({L}, t - start)))) AS md5
FROM w WHERE start < t"""


def _masked_sql(corpus: str = CORPUS, epoch: int = C.MASKED["epoch"]) -> str:
    p = C.MASKED
    L = p["L"]
    return f"""
WITH {corpus},
wins AS (
  SELECT r.j AS idx, least({L}, t - r.j * {L}) AS n,
         substr(h, 2 * r.j * {L} + 1, 2 * least({L}, t - r.j * {L})) AS hw
  FROM corpus, range(0, corpus.t // {L} + 1) r(j) WHERE t - r.j * {L} > 0),
arr AS (
  SELECT idx, n, list_transform(regexp_extract_all(hw, '..'), lambda x: ('0x' || x)::INTEGER) AS b FROM wins),
mk AS (
  SELECT idx, n, b,
         list_transform(b, lambda x, i: ('0x' || substr(md5(concat_ws('|', {p['seed']}, {epoch}, 0, idx, (i - 1) // 4)), 8 * ((i - 1) % 4) + 1, 8))::BIGINT
                                        / 4294967296.0 < {p['p']}) AS m
  FROM arr),
pad AS (SELECT *, list_resize([]::INTEGER[], {L} - n, {p['pad']}) AS padding, list_resize([]::INTEGER[], {L} - n, {p['mask']}) AS pad_targets FROM mk)
SELECT 0::BIGINT AS worker, idx::BIGINT AS idx, n::BIGINT AS n_real,
       list_sum(list_transform(m, lambda x: x::BIGINT))::BIGINT AS n_masked,
       md5(to_json(list_transform(list_zip(b, m), lambda z: CASE WHEN z[2] THEN {p['mask']} ELSE z[1] END) || padding)::VARCHAR) AS masked_md5,
       md5(to_json(b || padding)::VARCHAR) AS labels_md5,
       md5(to_json(list_transform(list_zip(b, m), lambda z: CASE WHEN z[2] THEN z[1] ELSE {p['mask']} END) || pad_targets)::VARCHAR) AS targets_md5
FROM pad"""


ORACLES: dict[str, str] = {
    "byte_windows": _windows_sql(C.FLAGSHIP_L, 1, 0, False),
    "byte_windows_sharded": _windows_sql(C.SHARDED["L"], C.SHARDED["workers"], C.SHARDED["epoch"], False),
    "byte_windows_tail": _windows_sql(C.TAIL["L"], C.TAIL["workers"], C.TAIL["epoch"], True),
    "byte_offsets": """
SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes,
       (sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        - octet_length(encode(text)))::BIGINT AS start
FROM documents""",
    "masked_windows": _masked_sql(),
    "text_bytes": """
SELECT conv_id, turn, octet_length(encode(text))::BIGINT AS n_bytes, hex(encode(text)) AS hex,
       array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INTEGER), ' ') AS int_string,
       decode(encode(text)) = text AS round_trip
FROM conversations""",
    "safe_decode": f"""
WITH {CORPUS},
w AS (SELECT r.j AS idx, coalesce(try(decode(unhex(substr(h, 2 * r.j * {C.SAFE_L} + 1, 2 * {C.SAFE_L})))), '{C.SAFE_DEFAULT}') AS txt
      FROM corpus, range(0, corpus.t // {C.SAFE_L}) r(j))
SELECT idx::BIGINT AS idx, txt <> '{C.SAFE_DEFAULT}' AS is_valid, length(txt)::BIGINT AS n_chars, md5(txt) AS text_md5 FROM w""",
    "row_shards": f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, count(*) OVER () // {C.ROW_SHARD_WORKERS} AS n FROM orders)
SELECT o_orderkey, row_idx::BIGINT AS row_idx, (row_idx // n)::BIGINT AS worker, (row_idx % n)::BIGINT AS item
FROM r WHERE row_idx < {C.ROW_SHARD_WORKERS} * n""",
}


# ---------------------------------------------------------------- plans
def _plan_sql(iters: int, start_epoch: int = 0, start_batch: int = 0) -> str:
    p = C.PLAN
    L, B = p["L"], p["B"]
    n_log, n_val = min(p["logs"], iters), min(p["valids"], iters)

    def pts(n: int) -> str:
        if n == 1:
            return "SELECT (SELECT cum0 FROM c0) AS p"
        return f"SELECT DISTINCT (SELECT cum0 FROM c0) + (r.i * ({iters} - 1)) // ({n} - 1) AS p FROM range(0, {n}) r(i)"

    return f"""
WITH tot AS (SELECT sum(octet_length(encode(text)))::BIGINT AS t FROM documents),
ep AS (SELECT e.epoch::BIGINT AS epoch, (greatest((t - e.epoch % {L}) // {L}, 0) // {B})::BIGINT AS n_batches
       FROM tot, range({start_epoch}, {start_epoch} + 400) e(epoch)),
ep2 AS (SELECT *, CASE WHEN epoch = {start_epoch} THEN {start_batch} ELSE 0 END AS first FROM ep),
ep3 AS (SELECT *, greatest(n_batches - first, 0) AS todo,
               coalesce(sum(greatest(n_batches - first, 0)) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS it0
        FROM ep2),
c0 AS (SELECT n_batches * epoch + {start_batch} AS cum0 FROM ep WHERE epoch = {start_epoch}),
logs AS ({pts(n_log)}),
vals AS ({pts(n_val)}),
r AS (SELECT (it0 + k.k)::BIGINT AS it, epoch, (first + k.k)::BIGINT AS batch, n_batches
      FROM ep3, range(0, todo) k(k) WHERE it0 < {iters})
SELECT it, epoch, batch,
       CASE WHEN batch = n_batches - 1 THEN epoch + 1 ELSE epoch END::BIGINT AS next_epoch,
       CASE WHEN batch = n_batches - 1 THEN 0 ELSE batch + 1 END::BIGINT AS next_batch,
       n_batches, (n_batches * epoch + batch)::BIGINT AS cum_batch,
       (batch + 1) % {p['acc']} = 0 AS grad_step,
       ((it + 1) * {B * L})::BIGINT AS elements_seen,
       (n_batches * epoch + batch) IN (SELECT p FROM logs) AS is_log_point,
       (n_batches * epoch + batch) IN (SELECT p FROM vals) AS is_valid_point
FROM r WHERE it < {iters}"""


def _batches_sql(B: int, drop_last: bool) -> str:
    L = C.PLAN["L"]
    keep = f"WHERE idx // {B} < (t // {L}) // {B}" if drop_last else ""
    return f"""
WITH {CORPUS},
w AS (SELECT r.j AS idx, t, md5(unhex(substr(h, 2 * r.j * {L} + 1, 2 * {L}))) AS m FROM corpus, range(0, corpus.t // {L}) r(j))
SELECT (idx // {B})::BIGINT AS batch, count(*)::BIGINT AS n_items, md5(string_agg(m, ',' ORDER BY idx)) AS batch_md5
FROM w {keep} GROUP BY 1"""


_b = C.BUDGET
_BUDGET_CTE = f"""
tot AS (SELECT sum(octet_length(encode(text)))::BIGINT AS t FROM documents),
b0 AS (SELECT (t * 3 // 2)::BIGINT AS global_target FROM tot),
b AS (SELECT global_target, global_target // {_b['workers']} AS local_target, {_b['B'] * _b['L']} AS epb FROM b0),
b2 AS (SELECT *, ((local_target + epb - 1) // epb)::BIGINT AS iters FROM b)"""

ORACLES.update(
    {
        "epoch_plan": _plan_sql(C.PLAN["iters"]),
        "resume_plan": _plan_sql(C.RESUME["iters"], C.RESUME["epoch"], C.RESUME["batch"]),
        "budget": f"""
WITH {_BUDGET_CTE}
SELECT global_target, local_target::BIGINT AS local_target, epb::BIGINT AS elements_per_batch, iters,
       (epb * iters)::BIGINT AS expected_local, (epb * iters * {_b['workers']})::BIGINT AS expected_global,
       (epb * iters * {_b['workers']} - global_target)::BIGINT AS delta
FROM b2""",
        "log_points": f"""
WITH {_BUDGET_CTE}
SELECT DISTINCT ((r.i * (iters - 1)) // (least({_b['log_amount']}, iters) - 1))::BIGINT AS point
FROM b2, range(0, least({_b['log_amount']}, b2.iters)) r(i)""",
        "batches": _batches_sql(C.PLAN["B"], True),
        "batches_eval": _batches_sql(C.BATCH_EVAL, False),
    }
)

# ---------------------------------------------------------------- run logs
LOG_CTE = """
lg AS (
  SELECT user_id AS run, (user_id % 4)::INTEGER AS gpu_rank, ts AS timestamp, (event_id + 1) * 8 AS elements_seen,
         CASE event_type WHEN 'purchase' THEN 'valid' WHEN 'signup' THEN 'test' ELSE 'train' END AS kind,
         (event_id // 1000)::INTEGER AS epoch, (event_id % 1000)::INTEGER AS batch, event_id AS cum_batch, value AS loss
  FROM events)"""

ORACLES.update(
    {
        "kind_counts": f"WITH {LOG_CTE} SELECT run, kind, count(*)::BIGINT AS n_rows FROM lg GROUP BY run, kind",
        "eval_mean": f"""
WITH {LOG_CTE},
m AS (SELECT run, epoch, avg(loss) AS eval_loss, count(*)::BIGINT AS eval_batches, sum(loss / 100.0) AS eval_seconds
      FROM lg WHERE kind = 'valid' AND batch < {C.EVAL_STEPS} GROUP BY run, epoch)
SELECT run, epoch, round(eval_loss, 6)::DECIMAL(24,6) AS eval_loss, eval_batches, round(eval_seconds, 6)::DECIMAL(24,6) AS eval_seconds
FROM m""",
        "last_loss": f"""
WITH {LOG_CTE},
ranked AS (SELECT run, loss, row_number() OVER (PARTITION BY run ORDER BY timestamp DESC, cum_batch DESC) AS rn FROM lg),
l AS (SELECT run, round(loss, 3)::DECIMAL(24,3) AS last_loss FROM ranked WHERE rn = 1)
SELECT run, last_loss, last_loss = lag(last_loss) OVER (ORDER BY run) AS equal_to_prev FROM l""",
        "chain_check": f"""
WITH {LOG_CTE},
e AS (SELECT run, min(cum_batch) AS min_cum_batch, max(cum_batch) AS max_cum_batch, max(epoch) AS max_epoch,
             sum(elements_seen) AS sum_elements FROM lg WHERE kind = 'train' GROUP BY run)
SELECT run, min_cum_batch, max_cum_batch,
       min_cum_batch = lag(max_cum_batch) OVER (ORDER BY run) + 1 AS starts_after_prev,
       sum_elements = lag(sum_elements) OVER (ORDER BY run) AS same_elements,
       max_epoch = lag(max_epoch) OVER (ORDER BY run) + 1 AS next_epoch
FROM e""",
        "top_checkpoints": f"""
WITH {LOG_CTE},
r AS (SELECT run, cum_batch, loss, row_number() OVER (PARTITION BY run ORDER BY loss, cum_batch) AS rnk FROM lg WHERE kind = 'valid')
SELECT run, rnk::BIGINT AS rank, cum_batch, loss, 'run' || run || '_top' || rnk AS checkpoint FROM r WHERE rnk <= {C.TOP_N}""",
        "best_model": f"""
WITH {LOG_CTE},
r AS (SELECT run, cum_batch, loss, row_number() OVER (PARTITION BY run ORDER BY loss, cum_batch) AS rnk FROM lg WHERE kind = 'valid')
SELECT run, cum_batch AS best_cum_batch, loss AS best_loss FROM r WHERE rnk = 1""",
        "running_elements": f"""
WITH {LOG_CTE}
SELECT run, cum_batch // 4 AS cum_batch, cum_batch AS event_id, round(loss * 100)::BIGINT AS tokens,
       sum(round(loss * 100)::BIGINT) OVER (PARTITION BY run ORDER BY cum_batch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS running_tokens
FROM lg""",
        "total_check": f"""
WITH {LOG_CTE},
t AS (SELECT run, sum(round(loss * 100)::BIGINT)::BIGINT AS seen, count(*) * 5000 AS expected FROM lg GROUP BY run)
SELECT run, seen, expected, seen - expected AS delta, seen >= expected AS reached FROM t""",
        "first_k": f"""
WITH {LOG_CTE},
r AS (SELECT run, cum_batch, row_number() OVER (PARTITION BY run ORDER BY cum_batch) AS rn FROM lg WHERE kind = 'train')
SELECT run, cum_batch FROM r WHERE rn <= {C.FIRST_K}""",
        "error_lines": """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, 'trainer' AS logger,
       CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'CRITICAL' END AS level,
       event_type || ' - ' || props AS message
FROM events WHERE event_type IN ('error', 'signup')""",
        "run_summary": f"""
WITH {LOG_CTE},
e AS (SELECT user_id AS run, arg_min(props, event_id) AS error FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT lg.run, strftime(min(timestamp), '%Y-%m-%dT%H:%M:%S.%f') AS started, strftime(max(timestamp), '%Y-%m-%dT%H:%M:%S.%f') AS ended,
       (max(gpu_rank) + 1)::BIGINT AS workers, count(*)::BIGINT AS n_rows, bool_or(cum_batch % 50 = 0) AS had_nan,
       any_value(error) AS error, lg.run % 7 <> 0 AS iso_ok
FROM lg LEFT JOIN e ON e.run = lg.run GROUP BY lg.run""",
        "nan_losses": "SELECT user_id AS run, event_id AS cum_batch FROM events WHERE event_id % 50 = 0",
        "lineage": """
WITH RECURSIVE r AS (
  SELECT event_id AS run_id, CASE WHEN event_id % 10 = 0 OR event_id % 97 = 0 THEN NULL ELSE event_id - 1 END AS up,
         event_id % 10 <> 0 AND event_id % 97 = 0 AS orphan FROM events),
known AS (
  SELECT r.run_id, p.run_id AS up, r.orphan OR (r.up IS NOT NULL AND p.run_id IS NULL) AS orphan FROM r LEFT JOIN r p ON p.run_id = r.up),
c AS (
  SELECT run_id, run_id AS root_run, 0::BIGINT AS depth, orphan FROM known WHERE up IS NULL
  UNION ALL SELECT k.run_id, c.root_run, c.depth + 1, k.orphan FROM known k JOIN c ON c.run_id = k.up)
SELECT run_id, root_run, depth, orphan FROM c""",
        "run_keys": "SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN page_id || '_b' END AS run FROM pages",
        "window_ones": f"""
WITH {CORPUS},
w AS (SELECT r.j AS idx, regexp_extract_all(substr(h, 2 * r.j * {C.FLAGSHIP_L} + 1, 2 * {C.FLAGSHIP_L}), '..') AS b
      FROM corpus, range(0, corpus.t // {C.FLAGSHIP_L} + 1) r(j) WHERE r.j * {C.FLAGSHIP_L} < t)
SELECT idx::BIGINT AS idx, len(b)::BIGINT AS n, len(b)::BIGINT AS ones, list_sum(list_transform(b, lambda x: ('0x' || x)::BIGINT))::BIGINT AS id_sum FROM w""",
        "question_types": f"""
WITH m(fn, kind) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in sorted(QUESTION_TYPES.items()))}),
n AS (SELECT list(fn ORDER BY fn) AS names FROM m)
SELECT p_partkey, m.kind AS question_type FROM part CROSS JOIN n LEFT JOIN m ON m.fn = n.names[p_partkey % 14 + 1]""",
        "first_records": f"""
SELECT o_orderkey AS idx, o_orderpriority AS question FROM orders
ORDER BY ('0x' || substr(md5(concat_ws('|', {C.RECORDS['seed']}, o_orderkey)), 1, 15))::BIGINT, o_orderkey LIMIT {C.RECORDS['n']}""",
        "one_record": "SELECT o_orderkey AS idx, o_orderpriority AS question FROM orders WHERE o_orderkey = 7",
        "jsonl_undo": """
WITH ops AS (SELECT user_id AS writer_id, event_id AS seq, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS d FROM events),
c AS (SELECT *, sum(d) OVER (PARTITION BY writer_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM ops),
h AS (SELECT *, cum - least(0, min(cum) OVER (PARTITION BY writer_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS ht FROM c),
m AS (SELECT *, min(ht) OVER (PARTITION BY writer_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS min_after FROM h)
SELECT writer_id, seq FROM m WHERE d = 1 AND min_after >= ht""",
    }
)


# ---------------------------------------------------------------- scoring / tokens / patches
def _bytes_of(expr: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({expr})), '..'), lambda x: ('0x' || x)::BIGINT)"


_TOPK = f"list_slice(list_sort(list_transform(l, lambda x, i: {{'v': -x, 'i': i - 1}})), 1, {max(int((1 - C.TOPK_THRES) * 64), 1)})"
_P = C.PATCH
_INNER = _P["seq_lens"][1] * _P["seq_lens"][2]
_T = C.TOK
_QW = C.QA["weights"]

ORACLES.update(
    {
        "ce_loss": f"""
WITH e AS (SELECT vec_id // {C.SEQ_LEN_EMB} AS seq, vec_id % {C.SEQ_LEN_EMB} AS pos, label, embedding::DOUBLE[] AS l,
                  list_max(embedding::DOUBLE[]) AS m FROM embeddings),
c AS (SELECT seq, pos,
             CASE WHEN label = {C.PAD_ID} THEN 0.0
                  ELSE ln(list_sum(list_transform(l, lambda x: exp(x - m)))) + m - l[label + 1] END AS ce,
             CASE pos % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END AS w
      FROM e)
SELECT seq::BIGINT AS seq, count(*)::BIGINT AS n, round(sum(ce), 6)::DECIMAL(24,6) AS ce_sum,
       round(coalesce(avg(CASE WHEN ce * w <> 0 THEN ce * w END), 0.0), 6)::DECIMAL(24,6) AS nonzero_mean,
       round(coalesce(avg(CASE WHEN pos % 4 = 0 THEN ce END), 'NaN'::DOUBLE), 6)::DECIMAL(24,6) AS masked_mean
FROM c GROUP BY seq""",
        "topk_filter": f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS l FROM embeddings),
k AS (SELECT vec_id, {_TOPK} AS top FROM e)
SELECT vec_id, array_to_string(list_sort(list_transform(top, lambda s: s.i)), ',') AS kept,
       round(list_sum(list_transform(top, lambda s: -s.v)), 6)::DECIMAL(24,6) AS kept_sum
FROM k""",
        "gumbel_sample": f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS l FROM embeddings),
k AS (SELECT vec_id, l, list_transform({_TOPK}, lambda s: s.i) AS keep FROM e),
s AS (SELECT vec_id, list_transform(l, lambda x, i:
        CASE WHEN list_contains(keep, i - 1)
             THEN x / {C.GUMBEL['T']} - ln(greatest(-ln(greatest(
                    (('0x' || substr(md5(concat_ws('|', {C.GUMBEL['seed']}, vec_id, i - 1)), 1, 15))::BIGINT >> 7) / 9007199254740992.0, 1e-20)), 1e-20))
             ELSE '-inf'::DOUBLE END) AS sc FROM k)
SELECT vec_id, (list_position(sc, list_max(sc)) - 1)::BIGINT AS sample FROM s""",
        "patches": f"""
WITH {CORPUS},
w AS (SELECT r.j AS idx, regexp_extract_all(substr(h, 2 * r.j * {_P['L']} + 1, 2 * {_P['L']}), '..') AS hx
      FROM corpus, range(0, corpus.t // {_P['L']}) r(j)),
b AS (SELECT idx, list_transform(hx, lambda x: ('0x' || x)::BIGINT) AS t FROM w),
p AS (SELECT idx, list_resize(t, ((len(t) + {_INNER - 1}) // {_INNER}) * {_INNER}, {_P['pad']}) AS pb,
             (len(t) + {_INNER - 1}) // {_INNER} AS n_outer FROM b)
SELECT idx::BIGINT AS idx, n_outer::BIGINT AS n_outer,
       md5(to_json(list_transform(range(0, n_outer), lambda o: list_transform(range(0, {_P['seq_lens'][1]}),
           lambda m: list_slice(pb, o * {_INNER} + m * {_P['seq_lens'][2]} + 1, o * {_INNER} + m * {_P['seq_lens'][2]} + {_P['seq_lens'][2]}))))::VARCHAR) AS nested_md5,
       true AS round_trip
FROM p""",
        "next_token_pairs": f"""
WITH x AS (SELECT conv_id, turn, {_bytes_of('text')} AS b FROM conversations)
SELECT conv_id, turn, len(b)::BIGINT AS n, md5(array_to_string([{_T.som_text}] || list_slice(b, 1, len(b) - 1), ' ')) AS inputs_md5 FROM x""",
        "tokenize_pad": f"""
WITH x AS (SELECT conv_id, turn, [{_T.som_text}] || {_bytes_of('text')} || [{_T.eom}] AS a FROM conversations)
SELECT conv_id, turn, len(a)::BIGINT AS n_tokens, md5(array_to_string(a, ' ')) AS tokens_md5,
       md5(array_to_string(list_resize(a, {C.TOKENIZE_LEN}, {_T.pad}), ' ')) AS padded_md5 FROM x""",
        "tokenize_crop": f"""
WITH x AS (SELECT conv_id, turn, [{_T.som_text}] || {_bytes_of('text')} || [{_T.eom}] AS a FROM conversations)
SELECT conv_id, turn, len(a) > {C.CROP_LEN} AS cropped, md5(array_to_string(list_resize(a, {C.CROP_LEN}, {_T.pad}), ' ')) AS fixed_md5 FROM x""",
        "qa_samples": f"""
WITH p AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer
           FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
           WHERE q.role = 'user'),
t AS (SELECT conv_id, turn, [{_T.som_text}] || {_bytes_of('question')} || [{_T.eom}] AS q,
             [{_T.som_image}, {_T.eom}]::BIGINT[] AS i,
             [{_T.som_text}] || {_bytes_of('answer')} || [{_T.eom}] AS a FROM p),
f AS (SELECT *, q || i || q || a AS fl,
             list_resize(list_resize([]::DOUBLE[], len(q), {_QW[0]}) || list_resize([]::DOUBLE[], len(i), {_QW[1]})
                         || list_resize([]::DOUBLE[], len(q), {_QW[2]}) || list_resize([]::DOUBLE[], len(a), {_QW[3]}), {C.QA['L']}, 0.0) AS w
      FROM t)
SELECT conv_id, turn, len(fl)::BIGINT AS n_tokens, ({C.QA['L']} - len(fl))::BIGINT AS len_padding,
       md5(to_json(list_resize(fl, {C.QA['L']}, {_T.pad}))::VARCHAR) AS tokens_md5,
       round(list_sum(w), 6)::DECIMAL(24,6) AS weight_sum, len(list_filter(w, lambda v: v <> 0))::BIGINT AS n_weighted
FROM f""",
    }
)


# ---------------------------------------------------------------- pixels
_I = C.IMG
_ROW = _I["width"] * _I["channels"]
_IMG_CTE = f"""
b AS (SELECT doc_id AS image_id, {_bytes_of('text')} AS b0 FROM documents),
img AS (SELECT image_id, (len(b0) + {_ROW - 1}) // {_ROW} AS h, {_I['width']} AS w, {_I['channels']} AS c,
               list_resize(b0, ((len(b0) + {_ROW - 1}) // {_ROW}) * {_ROW}, 0) AS px FROM b)"""
_STEP = 255 // _I["bins"]  # bins divide 255 evenly: every edge is an exact integer
_BINNED = f"list_transform(px, lambda x: least(x * {_I['bins']} // 255, {_I['bins'] - 1}) * {_STEP} + {_STEP // 2})"

ORACLES.update(
    {
        "crop": f"""
WITH {_IMG_CTE},
m AS (SELECT *, floor(least(h * {_I['crop'][0]}, h / 2))::BIGINT AS mh, floor(least(w * {_I['crop'][1]}, w / 2))::BIGINT AS mw FROM img)
SELECT image_id, (h - 2 * mh)::BIGINT AS height, (w - 2 * mw)::BIGINT AS width,
       md5(array_to_string(list_filter(px, lambda v, k: (k - 1) // (w * c) >= mh AND (k - 1) // (w * c) < h - mh
                                                    AND ((k - 1) // c) % w >= mw AND ((k - 1) // c) % w < w - mw), ',')) AS data_md5
FROM m""",
        "channel_bins": f"""
WITH {_IMG_CTE}, bb AS (SELECT image_id, {_BINNED} AS bv FROM img)
SELECT image_id, md5(array_to_string(bv, ',')) AS binned_md5, len(list_distinct(bv))::BIGINT AS n_values FROM bb""",
        "dense_remap": f"""
WITH {_IMG_CTE}, bb AS (SELECT image_id, {_BINNED} AS bv FROM img),
u AS (SELECT image_id, bv, list_sort(list_distinct(bv)) AS uq FROM bb),
r AS (SELECT image_id, uq, list_transform(bv, lambda x: list_position(uq, x) - 1) AS inv FROM u)
SELECT image_id, md5(array_to_string(list_transform(inv, lambda j: j + {_I['remap_start']}), ',')) AS remapped_md5,
       array_to_string(uq, ',') AS unique_values, md5(array_to_string(inv, ',')) AS inverse_md5
FROM r""",
        "grayscale": f"""
WITH {_IMG_CTE}
SELECT image_id, (h * w)::BIGINT AS n_pixels,
       md5(array_to_string(list_transform(range(0, h * w), lambda p:
           (19595 * px[3 * p + 1] + 38470 * px[3 * p + 2] + 7471 * px[3 * p + 3] + 32768) >> 16), ',')) AS gray_md5
FROM img""",
        "chw": f"""
WITH {_IMG_CTE}
SELECT image_id,
       md5(array_to_string(list_transform(range(0, h * w * c), lambda k:
           px[(k // (h * w)) + (((k // w) % h) * w + (k % w)) * c + 1]), ',')) AS chw_md5,
       true AS round_trip
FROM img""",
    }
)


# ---------------------------------------------------------------- keyed vectors, QA
_STATE_CTE = f"""
tgt AS (SELECT 'layer' || (vec_id % {C.STATE_KEYS}) AS key, (vec_id // {C.STATE_KEYS})::INTEGER AS row, embedding AS vec FROM embeddings),
src AS (SELECT key, row - {C.STATE_SHIFT} AS row, vec FROM tgt WHERE row - {C.STATE_SHIFT} >= 0)"""
_ANSWERS = ", ".join(f"('{k}', '{v}')" for k, v in ANSWER_CLASS_MAP.items())

ORACLES.update(
    {
        "extend_embeddings": f"""
WITH {_STATE_CTE},
j AS (SELECT t.key, t.row, t.vec AS tv, s.vec AS sv FROM tgt t LEFT JOIN src s ON s.key = t.key AND s.row = t.row)
SELECT key, row::BIGINT AS row,
       round(list_sum(CASE WHEN key IN ('layer0', 'layer2') AND sv IS NOT NULL THEN sv ELSE tv END::DOUBLE[]), 5)::DECIMAL(24,5) AS vec_sum,
       key IN ('layer0', 'layer2') AND sv IS NOT NULL AS from_source
FROM j""",
        "rename_keys": f"""
WITH {_STATE_CTE},
r AS (SELECT CASE WHEN starts_with(key, 'layer0') THEN 'stage0.embed' || substr(key, 7)
                  WHEN starts_with(key, 'layer1') THEN 'stage1.embed' || substr(key, 7) ELSE key END AS key, row FROM tgt)
SELECT key, count(*)::BIGINT AS n_rows, max(row)::BIGINT AS max_row FROM r GROUP BY key""",
        "param_count": f"""
WITH {_STATE_CTE}
SELECT key AS prefix, sum(len(vec))::BIGINT AS n_params FROM tgt WHERE key <> 'layer3' GROUP BY ROLLUP (key)""",
        "answer_map": f"""
WITH m(answer, code) AS (VALUES {_ANSWERS}),
w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part),
p AS (SELECT p_partkey, unnest(range(1, len(ws) + 1)) AS pos, ws FROM w)
SELECT p.p_partkey, p.pos::BIGINT AS pos, p.ws[p.pos] AS answer, m.code FROM p LEFT JOIN m ON m.answer = p.ws[p.pos]""",
        "token_collisions": f"""
WITH s(token, id) AS (VALUES ('pad', 0), ('eom', 10), ('som_text', 195), ('som_image', 128)),
b AS (SELECT unnest({_bytes_of('text')}) AS id FROM conversations)
SELECT s.token, s.id::BIGINT AS id, count(*)::BIGINT AS occurrences FROM b JOIN s ON s.id = b.id GROUP BY s.token, s.id""",
        "byte_profile": """
SELECT role, count(*)::BIGINT AS n, max(octet_length(encode(text)))::BIGINT AS max_bytes,
       round(avg(octet_length(encode(text))), 6)::DECIMAL(24,6) AS avg_bytes, count(*) FILTER (WHERE octet_length(encode(text)) > 205)::BIGINT AS n_over_limit
FROM conversations GROUP BY role""",
        "generation_quality": f"""
WITH p AS (SELECT q.conv_id, q.text AS question, a.text AS answer
           FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
           WHERE q.role = 'user'),
r AS (SELECT 'm' || (conv_id % 3) AS id_model,
             CASE WHEN octet_length(encode(question)) <= 205 THEN 'short' ELSE 'long' END AS question_type,
             {_bytes_of('answer')} AS truth, {_bytes_of('question')} AS gen,
             abs(octet_length(encode(question)) - octet_length(encode(answer))) / 100 AS ce FROM p)
SELECT id_model, question_type, count(*)::BIGINT AS n, round(avg(ce), 6)::DECIMAL(24,6) AS mean_ce,
       round(avg(CASE WHEN gen = truth THEN 1.0 ELSE 0.0 END), 6)::DECIMAL(24,6) AS exact_match,
       round(avg(CASE WHEN len(truth) = 0 THEN (CASE WHEN len(gen) = 0 THEN 1.0 ELSE 0.0 END)
         ELSE len(list_filter(range(1, least(len(gen), len(truth)) + 1), lambda i: gen[i] = truth[i])) / len(truth) END), 6)::DECIMAL(24,6) AS byte_accuracy
FROM r GROUP BY id_model, question_type""",
    }
)


# ---------------------------------------------------------------- streams
def _stream_limits_sql(shown: str) -> str:
    p = C.LIMITS
    return f"""
WITH b AS (SELECT conv_id, turn,
  list_transform({_bytes_of("coalesce(text, '')")}, lambda x, i: CASE WHEN (i - 1) % {p['every']} = {p['every'] - 1} THEN x + {p['shift']} ELSE x END) AS t FROM conversations),
c AS (SELECT conv_id, turn, t[1:least(CASE WHEN list_contains(t, {p['eos']}) THEN list_position(t, {p['eos']}) ELSE len(t) END, {p['max_tokens']})] AS kept FROM b)
SELECT conv_id, turn, array_to_string({shown or 'kept'}, ' ') AS text FROM c"""


ORACLES.update(
    {
        "stream_decode": "SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations",
        "stream_int": f"""
SELECT conv_id, turn,
       array_to_string(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::INTEGER), ' ') AS text
FROM conversations""",
        "stream_stop": f"""
SELECT conv_id, turn,
       CASE WHEN strpos(text, chr({C.STREAM_EOS})) > 0 THEN left(text, strpos(text, chr({C.STREAM_EOS}))) ELSE coalesce(text, '') END AS text
FROM conversations""",
        "stream_limits": _stream_limits_sql(""),
        "stream_overflow": _stream_limits_sql("list_filter(kept, lambda x: x <= 255)"),
        "stream_top": f"""
WITH {LOG_CTE},
r AS (SELECT run, cum_batch, loss, row_number() OVER (PARTITION BY run ORDER BY loss, cum_batch) AS rnk FROM lg WHERE kind = 'valid')
SELECT run, rnk::BIGINT AS rank, cum_batch, loss FROM r WHERE rnk <= {C.TOP_N}""",
        "metric_stream": f"""
WITH {LOG_CTE}
SELECT gpu_rank::BIGINT AS run, kind, count(*)::BIGINT AS n_rows, round(min(loss), 6)::DECIMAL(24,6) AS min_loss,
       round(arg_max(loss, cum_batch), 6)::DECIMAL(24,6) AS last_loss
FROM lg GROUP BY gpu_rank, kind""",
    }
)


ORACLES.update(
    {
        "random_windows": f"""
WITH {CORPUS},
s AS (SELECT r.i AS draw, ('0x' || substr(md5(concat_ws('|', {C.RANDOM['seed']}, r.i)), 1, 15))::BIGINT % (t - {C.RANDOM['L']}) AS start, h
      FROM corpus, range(0, {C.RANDOM['k']}) r(i))
SELECT draw::BIGINT AS draw, start::BIGINT AS start, {C.RANDOM['L']}::BIGINT AS n_bytes,
       md5(unhex(substr(h, 2 * start + 1, 2 * {C.RANDOM['L']}))) AS md5 FROM s""",
        "shuffle_order": f"""
SELECT doc_id, (row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws('|', {C.SHUFFLE['seed']}, {C.SHUFFLE['epoch']}, doc_id)), 1, 15))::BIGINT, doc_id) - 1)::BIGINT AS position
FROM documents""",
    }
)


ORACLES.update(
    {
        "rank_gate": f"""
WITH {LOG_CTE}
SELECT run, gpu_rank, kind, count(*)::BIGINT AS n_rows FROM lg WHERE gpu_rank IN (0, 2) GROUP BY run, gpu_rank, kind""",
        "next_token_rows": f"""
WITH x AS (SELECT conv_id, turn, {_bytes_of('text')} AS b FROM conversations),
r AS (SELECT conv_id, turn, unnest(range(0, len(b))) AS pos, b FROM x)
SELECT conv_id, turn, pos::BIGINT AS pos, b[pos + 1]::BIGINT AS token,
       coalesce(lag(b[pos + 1]) OVER (PARTITION BY conv_id, turn ORDER BY pos), {C.TOK.som_text})::BIGINT AS input
FROM r""",
    }
)


def _shuffled_sql(batch: int, drop_last: bool) -> str:
    L, p = C.PLAN["L"], C.SHUFFLED
    return f"""
WITH {CORPUS},
w AS (SELECT r.j AS idx, md5(unhex(substr(h, 2 * r.j * {L} + 1, 2 * {L}))) AS m, t // {L} AS n FROM corpus, range(0, corpus.t // {L}) r(j)),
o AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws('|', {p['seed']}, {p['epoch']}, idx)), 1, 15))::BIGINT, idx) - 1 AS pos FROM w)
SELECT (pos // {batch})::BIGINT AS batch, count(*)::BIGINT AS n_items, string_agg(idx::VARCHAR, ',' ORDER BY pos) AS windows,
       md5(string_agg(m, ',' ORDER BY pos)) AS batch_md5
FROM o {f'WHERE pos // {batch} < n // {batch}' if drop_last else ''} GROUP BY pos // {batch}"""


ORACLES["shuffled_batches"] = _shuffled_sql(C.PLAN["B"], True)
ORACLES["shuffled_batches_eval"] = _shuffled_sql(C.BATCH_EVAL, False)

# Windows of valid text are malformed at their ends only: each leading
# continuation byte becomes one U+FFFD, and so does a character cut at the end.
ORACLES["replace_decode"] = f"""
WITH {CORPUS},
w AS (SELECT r.j AS idx, substr(h, 2 * r.j * {C.SAFE_L} + 1, 2 * {C.SAFE_L}) AS x FROM corpus, range(0, corpus.t // {C.SAFE_L}) r(j)),
b AS (SELECT idx, list_transform(regexp_extract_all(x, '..'), lambda y: ('0x' || y)::INTEGER) AS b FROM w),
e AS (SELECT idx, b, len(b) AS n,
        CASE WHEN b[1] // 64 <> 2 THEN 0 WHEN b[2] // 64 <> 2 THEN 1 WHEN b[3] // 64 <> 2 THEN 2 ELSE 3 END AS lead,
        CASE WHEN b[len(b)] >= 192 OR (b[len(b)] // 64 = 2 AND b[len(b) - 1] >= 224)
               OR (b[len(b)] // 64 = 2 AND b[len(b) - 1] // 64 = 2 AND b[len(b) - 2] >= 240) THEN 1 ELSE 0 END AS cut FROM b)
SELECT idx::BIGINT AS idx, (len(list_filter(b, lambda y: y // 64 <> 2)) + lead)::BIGINT AS n_chars, (lead + cut)::BIGINT AS n_replaced FROM e"""

ORACLES["qa_image_samples"] = f"""
WITH {_IMG_CTE},
m AS (SELECT *, floor(least(h * {_I['crop'][0]}, h / 2))::BIGINT AS mh, floor(least(w * {_I['crop'][1]}, w / 2))::BIGINT AS mw FROM img),
k AS (SELECT image_id, h - 2 * mh AS h, w - 2 * mw AS w, c,
        list_filter(px, lambda v, k: (k - 1) // (w * c) >= mh AND (k - 1) // (w * c) < h - mh
                                     AND ((k - 1) // c) % w >= mw AND ((k - 1) // c) % w < w - mw) AS px FROM m),
bb AS (SELECT *, {_BINNED} AS bv FROM k),
u AS (SELECT *, list_sort(list_distinct(bv)) AS uq FROM bb),
r AS (SELECT *, list_transform(bv, lambda x: list_position(uq, x) - 1 + {_I['remap_start']}) AS rm FROM u),
i AS (SELECT image_id, list_transform(range(0, h * w * c), lambda k: rm[(k // (h * w)) + (((k // w) % h) * w + (k % w)) * c + 1]) AS pixels FROM r),
p AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer
      FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'),
t AS (SELECT conv_id, turn, len(pixels) AS n_pixels, [{_T.som_text}] || {_bytes_of('question')} || [{_T.eom}] AS q,
        [{_T.som_image}]::BIGINT[] || pixels || [{_T.eom}]::BIGINT[] AS im, [{_T.som_text}] || {_bytes_of('answer')} || [{_T.eom}] AS a
      FROM p JOIN i ON i.image_id = p.conv_id)
SELECT conv_id, turn, n_pixels::BIGINT AS n_pixels, ({C.QA_IMAGE_LEN} - len(q || im || q || a))::BIGINT AS len_padding,
       md5(array_to_string(im, ',')) AS image_md5, md5(array_to_string(q || im || q || a, ',')) AS tokens_md5
FROM t"""

ORACLES["raw_bytes"] = """
SELECT conv_id, turn, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, hex(encode(coalesce(text, ''))) AS hex
FROM conversations"""
