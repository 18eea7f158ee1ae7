"""Registered queries: one function per operator family, `(spark, data_dir) -> DataFrame`.

Every query reads the given tables whole. Outputs are flat (BIGINT, STRING,
rounded DOUBLE; arrays as strings or md5 digests) so that an independent SQL
engine can produce exactly the same rows; the SQL lives in `oracles.py`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelane.functions import bytes as B
from bytelane.functions import pixels as PX
from bytelane.functions import scoring as SC
from bytelane.functions import tokens as TK
from bytelane.operators import params as PM
from bytelane.operators import patches as PT
from bytelane.operators import qa as QA_
from bytelane.operators import runs as R
from bytelane.operators import windows as W
from bytelane.operators.offsets import global_row_index
from bytelane.plans import epochs as P
from bytelane.session import written
from bytelane.sources import logs as LG
from bytelane.sources.corpus import corpus_from_table, small_parts
from bytelane.streaming import bytestream as BS
from bytelane.streaming import runner as RN
from bytelane.sources.tables import table

# fixed parameters shared with the SQL oracles
FLAGSHIP_L = 2048
SHARDED = {"L": 1000, "workers": 3, "epoch": 5}
TAIL = {"L": 999, "workers": 2, "epoch": 7}
MASKED = {"L": 2048, "seed": 7, "epoch": 1, "p": 0.15, "mask": -100, "pad": -101}
ROW_SHARD_WORKERS = 4
SAFE_L = 1000
SAFE_DEFAULT = "<invalid>"


def dec(c, scale: int = 6) -> F.Column:
    """A computed DOUBLE as an exact DECIMAL(24, scale): engines that sum or
    average in another order still agree on every digit that is kept."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, scale).cast(f"decimal(24,{scale})")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return corpus_from_table(table(spark, d, "documents"), "doc_id", "text")


def _window_digest(w: DataFrame) -> DataFrame:
    return w.select(
        F.col("worker").cast("bigint").alias("worker"),
        F.col("idx").cast("bigint").alias("idx"),
        F.col("start").cast("bigint").alias("start"),
        F.col("n_bytes").cast("bigint").alias("n_bytes"),
        F.md5("tokens").alias("md5"),
    )


def q_byte_windows(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: W-1 + W-2 + W-3, L=2048, one worker, offset 0."""
    w, _ = W.byte_windows(documents(spark, d), FLAGSHIP_L)
    return _window_digest(w)


def q_byte_offsets(spark: SparkSession, d: str) -> DataFrame:
    """W-1: global byte offset of every document."""
    offs, _ = W.corpus_offsets(documents(spark, d))
    return offs.select("doc_id", F.col("n_bytes").cast("bigint"), F.col("start").cast("bigint"))


def q_byte_windows_sharded(spark: SparkSession, d: str) -> DataFrame:
    """W-2 / W-5 / W-6: three workers, epoch offset."""
    p = SHARDED
    w, _ = W.byte_windows(documents(spark, d), p["L"], workers=p["workers"], offset=p["epoch"])
    return _window_digest(w)


def q_byte_windows_tail(spark: SparkSession, d: str) -> DataFrame:
    """W-3 with the short window after the last full one (reads into the next shard)."""
    p = TAIL
    w, _ = W.byte_windows(documents(spark, d), p["L"], workers=p["workers"], offset=p["epoch"], include_tail=True)
    return _window_digest(w)


def q_masked_windows(spark: SparkSession, d: str) -> DataFrame:
    """F-15 / F-16 / W-8: masked samples, padded tail, md5 hash units."""
    p = MASKED
    w, _ = W.byte_windows(documents(spark, d), p["L"], include_tail=True)
    m = W.masked_sample(
        w, p["L"], mask_token_id=p["mask"], pad_token_id=p["pad"], masking_proba=p["p"],
        seed=p["seed"], epoch=p["epoch"], hash_mode="md5",
    )
    return masked_digest(m)


def masked_digest(m: DataFrame) -> DataFrame:
    """Masked samples as flat rows."""
    targets = W.mlm_targets("labels", "mask", MASKED["mask"])
    return m.select(
        F.col("worker").cast("bigint").alias("worker"),
        F.col("idx").cast("bigint").alias("idx"),
        F.col("n_bytes").cast("bigint").alias("n_real"),
        F.aggregate("mask", F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint")).alias("n_masked"),
        F.md5(F.to_json("masked_ids")).alias("masked_md5"),
        F.md5(F.to_json("labels")).alias("labels_md5"),
        F.md5(F.to_json(targets)).alias("targets_md5"),
    )


def q_text_bytes(spark: SparkSession, d: str) -> DataFrame:
    """F-1 / F-2 / F-7: text -> bytes -> byte list -> decimal string."""
    c = table(spark, d, "conversations")
    b = B.text_to_bytes("text")
    return c.select(
        "conv_id",
        "turn",
        F.octet_length(b).cast("bigint").alias("n_bytes"),
        F.hex(b).alias("hex"),
        B.array_to_int_string(B.text_to_array("text")).alias("int_string"),
        (B.array_to_text_strict(B.text_to_array("text")) == F.col("text")).alias("round_trip"),
    )


def q_safe_decode(spark: SparkSession, d: str) -> DataFrame:
    """F-4 / F-5: windows cut multi-byte characters; decode strictly or fall back."""
    w, _ = W.byte_windows(documents(spark, d), SAFE_L)
    txt = B.bytes_to_text_safe("tokens", SAFE_DEFAULT)
    return w.select(
        F.col("idx").cast("bigint").alias("idx"),
        (txt != F.lit(SAFE_DEFAULT)).alias("is_valid"),
        F.char_length(txt).cast("bigint").alias("n_chars"),
        F.md5(txt).alias("text_md5"),
    )


def q_replace_decode(spark: SparkSession, d: str) -> DataFrame:
    """F-6: decode windows with U+FFFD for every malformed sequence."""
    w, _ = W.byte_windows(documents(spark, d), SAFE_L)
    txt = B.bytes_to_text_replace("tokens")
    return w.select(
        F.col("idx").cast("bigint").alias("idx"),
        F.char_length(txt).cast("bigint").alias("n_chars"),
        (F.char_length(txt) - F.char_length(F.regexp_replace(txt, "�", ""))).cast("bigint").alias("n_replaced"),
    )


def q_row_shards(spark: SparkSession, d: str) -> DataFrame:
    """W-4: item-mode sharding of orders by key."""
    o = table(spark, d, "orders").select("o_orderkey")
    s = W.row_shards(o, "o_orderkey", workers=ROW_SHARD_WORKERS)
    return s.select("o_orderkey", F.col("row_idx").cast("bigint"), F.col("worker").cast("bigint"), F.col("item").cast("bigint"))


RANDOM = {"L": 2048, "k": 500, "seed": 5}
SHUFFLE = {"seed": 3, "epoch": 2}


def q_random_windows(spark: SparkSession, d: str) -> DataFrame:
    """W-7: 500 windows at hashed random starts in [0, total - L - 1]."""
    p = RANDOM
    r = W.random_windows(documents(spark, d), p["L"], p["k"], seed=p["seed"], hash_mode="md5")
    return r.select("draw", "start", F.octet_length("tokens").cast("bigint").alias("n_bytes"), F.md5("tokens").alias("md5"))


def q_shuffle_order(spark: SparkSession, d: str) -> DataFrame:
    """W-10 / T-8: seeded per-epoch random order of the documents, as a dense rank."""
    from bytelane.functions.hashing import hash_bits
    from bytelane.operators.offsets import global_row_index

    docs = table(spark, d, "documents").select("doc_id")
    keyed = docs.withColumn("h", hash_bits(F.lit(SHUFFLE["seed"]), F.lit(SHUFFLE["epoch"]), F.col("doc_id"), mode="md5"))
    ranked, _ = global_row_index(keyed, "h", "position", tiebreak=["doc_id"])
    return ranked.select("doc_id", F.col("position").cast("bigint"))

# ---------------------------------------------------------------- plans
PLAN = {"L": 2048, "B": 4, "iters": 1000, "acc": 3, "logs": 50, "valids": 10}
RESUME = {"epoch": 2, "batch": 100, "iters": 700}
BUDGET = {"workers": 4, "B": 4, "L": 2048, "log_amount": 100}
BATCH_EVAL = 5


def _plan(spark: SparkSession, d: str, iters: int, start_epoch: int = 0, start_batch: int = 0) -> DataFrame:
    p = PLAN
    _, tot = W.corpus_offsets(documents(spark, d))
    spec = W.shard_spec(tot.total, p["L"])
    lengths = P.window_batches(spec, p["B"], drop_last=True)
    plan = P.training_plan(
        spark, lengths, iters=iters, elements_per_batch=p["B"] * p["L"], start_epoch=start_epoch,
        start_batch=start_batch, accumulate_every=p["acc"], log_amount=p["logs"], validate_amount=p["valids"],
        period=p["L"],
    )
    return plan.select(
        "it", "epoch", "batch", "next_epoch", "next_batch", "n_batches", "cum_batch",
        "grad_step", "elements_seen", "is_log_point", "is_valid_point",
    )


def q_epoch_plan(spark: SparkSession, d: str) -> DataFrame:
    """W-11 / W-13 / W-15 / W-16 / A-16: the iteration plan of a run on the documents' windows."""
    return _plan(spark, d, PLAN["iters"])


def q_resume_plan(spark: SparkSession, d: str) -> DataFrame:
    """W-12: the same plan resumed at (epoch 2, batch 100)."""
    return _plan(spark, d, RESUME["iters"], RESUME["epoch"], RESUME["batch"])


def q_budget(spark: SparkSession, d: str) -> DataFrame:
    """W-14: iteration budget for 1.5 passes over the documents' bytes."""
    b = BUDGET
    tot = documents(spark, d).agg(F.sum(F.octet_length("content")).alias("t"))
    target = F.floor(F.col("t") * 3 / 2).cast("bigint")
    return tot.select(target.alias("global_target"), *P.budget_columns(target, b["workers"], b["B"], b["L"]))


def q_log_points(spark: SparkSession, d: str) -> DataFrame:
    """W-15: evenly spaced log points over the budget's iterations."""
    b = BUDGET
    t = documents(spark, d).agg(F.sum(F.octet_length("content")).alias("t")).first()["t"]
    bud = P.budget(t * 3 // 2, b["workers"], b["B"], b["L"])
    return P.log_points(spark, bud.iters, b["log_amount"])


SHUFFLED = {"seed": 3, "epoch": 2}


def _shuffled(spark: SparkSession, d: str, batch_size: int, drop_last: bool) -> DataFrame:
    from bytelane.functions.hashing import hash_bits
    from bytelane.operators.offsets import global_row_index, join_small_or_shuffle

    w, spec = W.byte_windows(documents(spark, d), PLAN["L"])
    # the order is drawn for window numbers alone; contents join it afterwards
    h = hash_bits(F.lit(SHUFFLED["seed"]), F.lit(SHUFFLED["epoch"]), F.col("idx"), mode="md5")
    drawn = spark.range(spec.count).select(F.col("id").alias("idx")).withColumn("h", h)
    order, tot = global_row_index(drawn, "h", "position", tiebreak=["idx"])
    placed = join_small_or_shuffle(w.select("idx", F.md5("tokens").alias("md5")), order.select("idx", "position"), "idx", tot.rows)
    kept = P.keep_full_batches(placed, "position", spec.count, batch_size, drop_last)
    c = P.collate(kept, "position", ["idx", "md5"])
    return c.select(
        "batch",
        F.size("items").cast("bigint").alias("n_items"),
        F.array_join(F.transform("items", lambda x: x["idx"].cast("string")), ",").alias("windows"),
        F.md5(F.array_join(F.transform("items", lambda x: x["md5"]), ",")).alias("batch_md5"),
    )


def q_shuffled_batches(spark: SparkSession, d: str) -> DataFrame:
    """U-3 / W-9 / W-10: training batches of the windows in one epoch's random order, short batch dropped."""
    return _shuffled(spark, d, PLAN["B"], True)


def q_shuffled_batches_eval(spark: SparkSession, d: str) -> DataFrame:
    """U-3 / W-9 / W-10: the same order in batches of 5, short batch kept."""
    return _shuffled(spark, d, BATCH_EVAL, False)


def _batches(spark: SparkSession, d: str, batch_size: int, drop_last: bool) -> DataFrame:
    w, spec = W.byte_windows(documents(spark, d), PLAN["L"])
    kept = P.keep_full_batches(w.withColumn("md5", F.md5("tokens")), "idx", spec.count, batch_size, drop_last)
    c = P.collate(kept, "idx", ["md5"])
    return c.select(
        "batch",
        F.size("items").cast("bigint").alias("n_items"),
        F.md5(F.array_join(F.transform("items", lambda x: x["md5"]), ",")).alias("batch_md5"),
    )


def q_batches(spark: SparkSession, d: str) -> DataFrame:
    """W-9 / A-15: training batches of 4 windows, last short batch dropped."""
    return _batches(spark, d, PLAN["B"], True)


def q_batches_eval(spark: SparkSession, d: str) -> DataFrame:
    """W-9: evaluation batches of 5 windows, last short batch kept."""
    return _batches(spark, d, BATCH_EVAL, False)


# ---------------------------------------------------------------- run logs
EVAL_STEPS = 500
TOP_N = 3
FIRST_K = 30


def loss_log(spark: SparkSession, d: str) -> DataFrame:
    return LG.loss_log_from_events(table(spark, d, "events"))


def q_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    """A-6 / PF-2: rows per run and kind."""
    return R.kind_counts(loss_log(spark, d), ["run"])


def q_eval_mean(spark: SparkSession, d: str) -> DataFrame:
    """A-1 / A-2: mean and forward time of each evaluation, both over its first 500 batches."""
    lg = loss_log(spark, d)
    m = R.eval_mean(lg, ["run", "epoch"], EVAL_STEPS)
    t = R.eval_time(LG.time_log_from_events(table(spark, d, "events")), lg, ["run", "epoch"], EVAL_STEPS)
    return m.join(t, ["run", "epoch"], "full").select(
        "run", "epoch", dec("eval_loss").alias("eval_loss"), "eval_batches", dec("eval_seconds").alias("eval_seconds")
    )


def q_last_loss(spark: SparkSession, d: str) -> DataFrame:
    """A-9 / J-7: last loss of any kind per run, rounded to 3, compared with the previous run."""
    last = R.last_value(loss_log(spark, d), ["run"]).withColumn("last_loss", dec("last_loss", 3))
    return R.grad_acc_check(last, "run")


def q_chain_check(spark: SparkSession, d: str) -> DataFrame:
    """J-5 / A-7 / A-8: does each run continue the previous one."""
    return R.chain_check(R.run_extents(loss_log(spark, d), ["run"]), "run")


def q_top_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """T-1 .. T-3: three best validation losses per run, ranked and named."""
    v = R.by_kind(loss_log(spark, d), "valid").withColumn("model", F.concat(F.lit("run"), F.col("run").cast("string")))
    t = R.best_checkpoints(v, ["run"], TOP_N, "model")
    return t.select("run", F.col("rank").cast("bigint").alias("rank"), "cum_batch", "loss", "checkpoint")


def q_best_model(spark: SparkSession, d: str) -> DataFrame:
    """T-4: best validation row per run."""
    return R.best_model(R.by_kind(loss_log(spark, d), "valid"), ["run"])


def q_running_elements(spark: SparkSession, d: str) -> DataFrame:
    """A-16: running token total per run (value in cents as tokens); four log rows share a cumulative batch."""
    lg = loss_log(spark, d).select(
        "run", F.expr("cum_batch div 4").alias("cum_batch"), F.col("cum_batch").alias("event_id"),
        F.round(F.col("loss") * 100).cast("bigint").alias("tokens"))
    return R.running_total(lg, "run", "cum_batch", "tokens", "running_tokens", ties=["event_id"])


def q_total_check(spark: SparkSession, d: str) -> DataFrame:
    """A-16: tokens seen per run against a target of 5,000 for each logged row."""
    lg = loss_log(spark, d).select("run", F.round(F.col("loss") * 100).cast("bigint").alias("tokens"))
    n = lg.groupBy("run").agg((F.count(F.lit(1)) * 5000).alias("target"))
    return R.total_check(lg.join(n, "run"), ["run"], "tokens", F.col("target"))


def q_first_k(spark: SparkSession, d: str) -> DataFrame:
    """W-22: the first 30 training rows of each run."""
    lg = R.by_kind(loss_log(spark, d), "train")
    return P.first_k(lg, ["run"], ["cum_batch"], FIRST_K).select("run", "cum_batch")


def q_error_lines(spark: SparkSession, d: str) -> DataFrame:
    """PF-3: ERROR / CRITICAL lines of a text log."""
    return R.error_lines(LG.log_lines_from_events(table(spark, d, "events")))


def q_run_summary(spark: SparkSession, d: str) -> DataFrame:
    """A-17 / PF-6 / PF-7: run start, end, workers, rows, NaN flag, first error; ISO check of rendered times.

    Every 50th loss is NaN, and each 7th run renders its times in another way.
    """
    lg = loss_log(spark, d).withColumn("loss", F.when(F.pmod("cum_batch", F.lit(50)) == 0, float("nan")).otherwise(F.col("loss")))
    ev = table(spark, d, "events").where(F.col("event_type") == "error")
    errors = ev.select(F.col("user_id").alias("run"), F.col("event_id").alias("time"), F.col("props").alias("message"))
    s = R.run_summary(lg, ["run"], errors=errors)
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    shown = F.when(F.pmod("run", F.lit(7)) == 0, F.date_format("started", "dd.MM.yyyy")).otherwise(F.date_format("started", fmt))
    return s.select(
        "run",
        F.date_format("started", fmt).alias("started"),
        F.date_format("ended", fmt).alias("ended"),
        F.col("workers").cast("bigint").alias("workers"),
        "n_rows",
        "had_nan",
        "error",
        (R.valid_iso(shown) & R.valid_iso(F.date_format("ended", fmt))).alias("iso_ok"),
    )


def q_nan_losses(spark: SparkSession, d: str) -> DataFrame:
    """PF-6: the log rows whose loss is NaN (every 50th is made one)."""
    lg = loss_log(spark, d).withColumn("loss", F.when(F.pmod("cum_batch", F.lit(50)) == 0, float("nan")).otherwise(F.col("loss")))
    return R.nan_losses(lg).select("run", "cum_batch")


def q_lineage(spark: SparkSession, d: str) -> DataFrame:
    """J-6: resume chains of up to ten runs, one event a run; some parents are lost."""
    e = F.col("event_id")
    runs = table(spark, d, "events").select(
        e.alias("run_id"), F.concat(F.lit("ckpt"), e).alias("checkpoint_file"),
        F.when(e % 10 == 0, F.lit(None)).when(e % 97 == 0, F.lit("lost")).otherwise(F.concat(F.lit("ckpt"), e - 1)).alias("resumed_from"))
    return R.resume_lineage(runs)


def q_run_keys(spark: SparkSession, d: str) -> DataFrame:
    """IO-22: run ids from artefact paths; the id may hold the separator, other folders give none."""
    p = table(spark, d, "pages").select("page_id")
    model = F.when(F.pmod("page_id", F.lit(5)) == 0, "other").otherwise("my_model")
    path = F.concat(F.lit("/out/"), model, F.lit("_"), F.col("page_id"), F.lit("_b/loss.csv"))
    return p.select("page_id", R.run_key_from_path(path, "my_model").alias("run"))


def q_window_ones(spark: SparkSession, d: str) -> DataFrame:
    """F-14: windows as ids with an all-ones loss mask."""
    w, _ = W.byte_windows(documents(spark, d), FLAGSHIP_L, include_tail=True)
    m = W.with_loss_mask(w)
    return m.select(
        F.col("idx").cast("bigint").alias("idx"), F.size("token_ids").cast("bigint").alias("n"),
        F.aggregate("loss_mask", F.lit(0.0).cast("double"), lambda a, x: a + x).cast("bigint").alias("ones"),
        F.aggregate("token_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


def q_jsonl_undo(spark: SparkSession, d: str) -> DataFrame:
    """IO-11: rows surviving undo in an append log (errors undo the user's last row)."""
    ev = table(spark, d, "events").select(
        F.col("user_id").alias("writer_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "undo").otherwise("put").alias("op"),
    )
    return LG.jsonl_view(ev).select("writer_id", "seq")


# ---------------------------------------------------------------- scoring
SEQ_LEN_EMB = 8
PAD_ID = 0
TOPK_THRES = 0.9
GUMBEL = {"T": 0.7, "seed": 11}


def _emb(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(
        "vec_id",
        "embedding",
        "label",
        F.floor(F.col("vec_id") / SEQ_LEN_EMB).cast("bigint").alias("seq"),
        F.pmod("vec_id", F.lit(SEQ_LEN_EMB)).alias("pos"),
    )


def q_ce_loss(spark: SparkSession, d: str) -> DataFrame:
    """A-3 / A-4 / A-5: cross-entropy per position (pad ignored), nonzero weighted mean, masked mean."""
    e = _emb(spark, d).withColumn("ce", SC.cross_entropy("embedding", "label", ignore_index=PAD_ID))
    w = F.when(F.pmod("pos", F.lit(3)) == 0, 1.0).when(F.pmod("pos", F.lit(3)) == 1, 0.5).otherwise(0.0)
    return e.groupBy("seq").agg(
        F.count(F.lit(1)).alias("n"),
        dec(F.sum("ce")).alias("ce_sum"),
        dec(SC.nonzero_weighted_mean(F.col("ce"), w)).alias("nonzero_mean"),
        dec(SC.masked_mean(F.col("ce"), F.pmod("pos", F.lit(4)) == 0)).alias("masked_mean"),
    )


def q_topk_filter(spark: SparkSession, d: str) -> DataFrame:
    """T-5: indices kept by the top-k filter (k = max(int(0.1 V), 1)) and their logit sum."""
    e = table(spark, d, "embeddings")
    k = SC.top_k_count(64, TOPK_THRES)
    f = SC.top_k_filter("embedding", k)
    kept = F.filter(f, lambda x: x > F.lit(float("-inf")))
    return e.select(
        "vec_id",
        F.array_join(SC.top_k_indices("embedding", k), ",").alias("kept"),
        dec(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)).alias("kept_sum"),
    )


def q_gumbel_sample(spark: SparkSession, d: str) -> DataFrame:
    """F-24 after T-5: one temperature / Gumbel draw per row (md5 noise, reproducible)."""
    e = table(spark, d, "embeddings")
    k = SC.top_k_count(64, TOPK_THRES)
    f = SC.top_k_filter("embedding", k)
    g = SC.gumbel_argmax(f, GUMBEL["T"], F.lit(GUMBEL["seed"]), F.col("vec_id"), hash_mode="md5")
    return e.select("vec_id", g.cast("bigint").alias("sample"))


# ---------------------------------------------------------------- tokens / patches
PATCH = {"L": 1000, "seq_lens": [32, 8, 4], "pad": 256}
TOK = TK.TokenIds(pad=256, eom=257, som_text=259, som_image=258)
TOKENIZE_LEN = 4096
CROP_LEN = 512
QA = {"L": 8192, "weights": (0.5, 0.25, 0.5, 1.0)}


def q_patches(spark: SparkSession, d: str) -> DataFrame:
    """W-19 / W-20: windows nested into (32, 8, 4) patches and flattened back."""
    p = PATCH
    w, _ = W.byte_windows(documents(spark, d), p["L"])
    n = PT.patch_windows(w.select("idx", "tokens"), p["seq_lens"], p["pad"])
    back = PT.from_patches("patches", 2, F.octet_length("tokens"))
    return n.select(
        F.col("idx").cast("bigint").alias("idx"),
        F.size("patches").cast("bigint").alias("n_outer"),
        F.md5(F.to_json("patches")).alias("nested_md5"),
        (back == B.bytes_to_array("tokens").cast("array<bigint>")).alias("round_trip"),
    )


def q_next_token_pairs(spark: SparkSession, d: str) -> DataFrame:
    """W-18: inputs shifted right by one with a start token."""
    c = table(spark, d, "conversations")
    inp = PT.shift_right(B.text_to_array("text"), TOK.som_text)
    return c.select("conv_id", "turn", F.size(inp).cast("bigint").alias("n"), F.md5(F.array_join(inp, " ")).alias("inputs_md5"))


def q_tokenize_pad(spark: SparkSession, d: str) -> DataFrame:
    """F-10 .. F-12: start-of-text + bytes + end-of-modality, padded to 4,096; a longer row is an error."""
    c = table(spark, d, "conversations")
    a = TK.with_eom(TK.with_som(B.text_to_array("text"), TOK.som_text), TOK.eom)
    padded = TK.pad_right_to(a, TOKENIZE_LEN, TOK.pad)
    return c.select(
        "conv_id", "turn", F.size(a).cast("bigint").alias("n_tokens"),
        F.md5(F.array_join(a, " ")).alias("tokens_md5"),
        F.md5(F.array_join(padded, " ")).alias("padded_md5"),
    )


def q_tokenize_crop(spark: SparkSession, d: str) -> DataFrame:
    """F-11 with cropping allowed: fixed rows of 512 tokens, longer ones lose their end (that is the feature)."""
    c = table(spark, d, "conversations")
    a = TK.with_eom(TK.with_som(B.text_to_array("text"), TOK.som_text), TOK.eom)
    fixed = TK.pad_right_to(a, CROP_LEN, TOK.pad, strict=False)
    return c.select("conv_id", "turn", (F.size(a) > CROP_LEN).alias("cropped"), F.md5(F.array_join(fixed, " ")).alias("fixed_md5"))


def qa_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(question, answer) = a user turn and the assistant turn right after it."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    q = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    return q.join(a, ["conv_id", "turn"])


def q_qa_samples(spark: SparkSession, d: str) -> DataFrame:
    """F-13 / F-17: question . image . question . answer samples (text-only rows: empty image)."""
    p = qa_pairs(spark, d)
    s = TK.qa_sample(
        B.text_to_array("question"), F.array().cast("array<int>"), B.text_to_array("answer"),
        TOK, QA["L"], QA["weights"],
    ).alias("s")
    x = p.select("conv_id", "turn", s)
    return x.select(
        "conv_id",
        "turn",
        (F.lit(QA["L"]) - F.col("s.len_padding")).cast("bigint").alias("n_tokens"),
        F.col("s.len_padding").cast("bigint").alias("len_padding"),
        F.md5(F.to_json("s.tokens")).alias("tokens_md5"),
        dec(F.aggregate("s.loss_mask", F.lit(0.0), lambda a, v: a + v)).alias("weight_sum"),
        F.size(F.array_remove("s.loss_mask", 0.0)).cast("bigint").alias("n_weighted"),
    )


# ---------------------------------------------------------------- pixels
IMG = {"width": 16, "channels": 3, "crop": (0.25, 0.20), "bins": 5, "remap_start": 11}


def images(spark: SparkSession, d: str) -> DataFrame:
    """Document bytes read as 16-pixel-wide RGB images (last row zero-padded)."""
    docs = small_parts(documents(spark, d).select("doc_id", "content"))
    return docs.select(F.col("doc_id").alias("image_id"), PX.image_from_bytes("content", IMG["width"], IMG["channels"]).alias("img"))


def _md5_ints(a: F.Column) -> F.Column:
    return F.md5(F.array_join(a, ","))


def q_crop(spark: SparkSession, d: str) -> DataFrame:
    """F-18: center crop by (25 %, 20 %)."""
    c = images(spark, d).select("image_id", PX.crop(F.col("img"), *IMG["crop"]).alias("c"))
    return c.select(
        "image_id", F.col("c.height").cast("bigint").alias("height"), F.col("c.width").cast("bigint").alias("width"),
        _md5_ints(F.col("c.data")).alias("data_md5"),
    )


def q_channel_bins(spark: SparkSession, d: str) -> DataFrame:
    """F-19: channel values binned to 5 bins (mean value of each bin)."""
    b = images(spark, d).select("image_id", PX.downsample_channels(F.col("img.data"), IMG["bins"]).alias("b"))
    return b.select("image_id", _md5_ints(F.col("b")).alias("binned_md5"), F.size(F.array_distinct("b")).cast("bigint").alias("n_values"))


def q_dense_remap(spark: SparkSession, d: str) -> DataFrame:
    """A-13: binned values remapped densely from 11."""
    b = images(spark, d).select("image_id", PX.dense_remap(PX.downsample_channels(F.col("img.data"), IMG["bins"]), IMG["remap_start"]).alias("r"))
    return b.select(
        "image_id",
        _md5_ints(F.col("r.remapped")).alias("remapped_md5"),
        F.array_join("r.unique", ",").alias("unique_values"),
        _md5_ints(F.col("r.inverse")).alias("inverse_md5"),
    )


def q_grayscale(spark: SparkSession, d: str) -> DataFrame:
    """F-20: RGB -> luma."""
    g = images(spark, d).select("image_id", PX.grayscale(F.col("img")).alias("g"))
    return g.select("image_id", F.size("g.data").cast("bigint").alias("n_pixels"), _md5_ints(F.col("g.data")).alias("gray_md5"))


def q_chw(spark: SparkSession, d: str) -> DataFrame:
    """F-9: HWC -> CHW layout and back."""
    c = images(spark, d).select("image_id", "img", PX.hwc_to_chw(F.col("img")).alias("chw"))
    back = PX.chw_to_hwc(F.col("chw"), F.col("img.height"), F.col("img.width"), F.col("img.n_channels"))
    return c.select("image_id", _md5_ints(F.col("chw")).alias("chw_md5"), (back == F.col("img.data")).alias("round_trip"))


QA_IMAGE_LEN = 65_536


def q_qa_image_samples(spark: SparkSession, d: str) -> DataFrame:
    """J-1 / F-17 / F-22: each question with its conversation's image, cropped, binned and remapped once per image.

    The image of a conversation is the document of the same number.
    """
    p = qa_pairs(spark, d).withColumn("image_id", F.col("conv_id"))
    asked = images(spark, d).join(p.select("image_id").distinct(), "image_id", "left_semi")
    pixels = PX.process_images(asked, "image_id", "img", crop_hw=IMG["crop"], bins=IMG["bins"], shift_start=IMG["remap_start"])
    x = QA_.join_images(p, pixels, "image_id")
    s = TK.qa_sample(B.text_to_array("question"), F.col("pixels"), B.text_to_array("answer"), TOK, QA_IMAGE_LEN, QA["weights"])
    x = x.select("conv_id", "turn", F.size("pixels").cast("bigint").alias("n_pixels"), s.alias("s"))
    return x.select(
        "conv_id", "turn", "n_pixels", F.col("s.len_padding").cast("bigint").alias("len_padding"),
        F.md5(F.array_join("s.i", ",")).alias("image_md5"),
        F.md5(F.array_join(F.slice("s.tokens", 1, F.lit(QA_IMAGE_LEN) - F.col("s.len_padding").cast("int")), ",")).alias("tokens_md5"),
    )


# ---------------------------------------------------------------- keyed vectors
STATE_KEYS = 4
STATE_SHIFT = 25
RENAME_RULES = [("layer0", "stage0.embed"), ("layer1", "stage1.embed")]


def state_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Target state: embeddings as `layer{vec_id % 4}` rows; source state: the same
    vectors moved up by 25 rows, i.e. a smaller table of the same keys and width."""
    e = table(spark, d, "embeddings")
    key = F.concat(F.lit("layer"), F.pmod("vec_id", F.lit(STATE_KEYS)).cast("string"))
    row = F.floor(F.col("vec_id") / STATE_KEYS).cast("int")
    tgt = e.select(key.alias("key"), row.alias("row"), F.col("embedding").alias("vec"))
    src = tgt.select("key", (F.col("row") - STATE_SHIFT).alias("row"), "vec").where(F.col("row") >= 0)
    return src, tgt


def _vec_sum(c: str) -> F.Column:
    return dec(F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 5)


def q_extend_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """J-4: source rows overwrite the first rows of layers 0 and 2; the rest keep the target."""
    src, tgt = state_tables(spark, d)
    out = PM.extend_embeddings(src, tgt, ["layer0", "layer2"])
    return out.select("key", F.col("row").cast("bigint").alias("row"), _vec_sum("vec").alias("vec_sum"), "from_source")


def q_rename_keys(spark: SparkSession, d: str) -> DataFrame:
    """PF-4: prefix rename of state keys, rules in order."""
    _, tgt = state_tables(spark, d)
    r = PM.rename_keys(tgt, RENAME_RULES)
    return r.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.max("row").cast("bigint").alias("max_row"))


def q_param_count(spark: SparkSession, d: str) -> DataFrame:
    """A-11: trainable elements per key (layer3 frozen), with the total."""
    _, tgt = state_tables(spark, d)
    return PM.param_count(tgt, F.col("key"), trainable=F.col("key") != "layer3")


def q_question_types(spark: SparkSession, d: str) -> DataFrame:
    """J-3: the type of a question from the last step of its program; every 14th step is unknown."""
    names = F.array(*[F.lit(x) for x in sorted(QA_.QUESTION_TYPES)])
    fn = F.get(names, F.pmod("p_partkey", F.lit(14)).cast("int"))
    step = lambda f: F.struct(f.alias("function"))
    p = table(spark, d, "part").select("p_partkey", F.array(step(F.lit("count")), step(F.coalesce(fn, F.lit("scene")))).alias("program"))
    return p.select("p_partkey", QA_.question_type("program").alias("question_type"))


RECORDS = {"seed": 4, "n": 50}


def q_first_records(spark: SparkSession, d: str) -> DataFrame:
    """IO-8 / T-6: the first 50 question records in seeded random order (the limit is the feature)."""
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("question"))
    return QA_.iter_records(q, shuffle=True, seed=RECORDS["seed"], max_items=RECORDS["n"], hash_mode="md5")


def q_one_record(spark: SparkSession, d: str) -> DataFrame:
    """IO-7: the record of one index."""
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("question"))
    return QA_.raw_record(q, 7, "valid")


def q_answer_map(spark: SparkSession, d: str) -> DataFrame:
    """J-2: every word of every part name as an answer, mapped to its class code (null if unknown)."""
    p = table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "answer"))
    return p.select(
        "p_partkey", (F.col("pos") + 1).cast("bigint").alias("pos"), "answer",
        QA_.answer_codes(p, "answer", strict=False).alias("code"),
    )


def q_token_collisions(spark: SparkSession, d: str) -> DataFrame:
    """J-8: special ids of a config that reuses byte values (pad 0, eom 10, som_text 195,
    som_image 128) against the conversation bytes: newline and the UTF-8 lead byte collide."""
    c = table(spark, d, "conversations").select(B.text_to_array("text").alias("t"))
    ids = TK.TokenIds(pad=0, eom=10, som_text=195, som_image=128)
    return QA_.token_collisions(c, "t", ids).select("token", "id", F.col("occurrences").cast("bigint"))


def q_byte_profile(spark: SparkSession, d: str) -> DataFrame:
    """F-26: byte lengths of conversation turns per role against the 205-byte question limit."""
    p = QA_.byte_profile(table(spark, d, "conversations"), ["role"], "text")
    return p.withColumn("avg_bytes", dec("avg_bytes"))


def q_generation_quality(spark: SparkSession, d: str) -> DataFrame:
    """A-18: mean cross entropy, exact match and byte accuracy of generated answers per model and question type.

    Stand-in records: the truth is the assistant turn, the "generation" the
    user turn before it (a parrot model), the cross entropy the difference of
    their lengths in hundreds of bytes; models by conversation id mod 3.
    """
    p = qa_pairs(spark, d)
    recs = p.select(
        F.concat(F.lit("m"), F.pmod("conv_id", F.lit(3)).cast("string")).alias("id_model"),
        F.when(F.octet_length("question") <= QA_.MAX_QUESTION_LEN_BYTES, "short").otherwise("long").alias("question_type"),
        B.text_to_array("answer").alias("truth"),
        B.text_to_array("question").alias("generated"),
        (F.abs(F.octet_length("question") - F.octet_length("answer")) / 100).alias("ce"),
    )
    q = R.generation_quality(recs, ["id_model", "question_type"])
    return q.select("id_model", "question_type", "n", *[dec(c).alias(c) for c in ("mean_ce", "exact_match", "byte_accuracy")])


# ---------------------------------------------------------------- streams
STREAM_CHUNKS = 3
STREAM_EOS = 10  # newline


def numbered_turns(spark: SparkSession, d: str) -> DataFrame:
    """`(stream_id, conv_id, turn, text)`: every row of the conversations is a stream of its own.

    The number is the dense position by conversation, turn and text, so rows
    that share a turn, or have none, stay apart. It is written once, so that
    the tokens and the results carry the same numbers.
    """
    c = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    idx, tot = global_row_index(c.withColumn("_h", F.xxhash64("text")), "conv_id", "stream_id", tiebreak=["turn", "_h"], keep=["text"])
    out = written(idx.select("stream_id", "conv_id", "turn", "text"), "turns")
    tot.release()
    return out


def turn_tokens(turns: DataFrame, end_marker: bool = True) -> DataFrame:
    """Every turn as a token stream `(stream_id, seq, token)` (+ an END row)."""
    toks = turns.select("stream_id", F.posexplode(B.text_to_array("text")).alias("seq", "token")).select(
        "stream_id", F.col("seq").cast("long"), F.col("token").cast("long")
    )
    if end_marker:
        ends = turns.select("stream_id", F.octet_length("text").cast("long").alias("seq"), F.lit(BS.END).cast("long").alias("token"))
        toks = toks.unionByName(ends)
    return toks


def _stream_text(spark: SparkSession, d: str, name: str, mode: str, change=lambda tokens: tokens, **kw) -> DataFrame:
    path = RN.scratch(spark, name + "-in")
    turns = numbered_turns(spark, d)
    files = RN.write_token_files(change(turn_tokens(turns)), path, STREAM_CHUNKS)
    out = RN.run_available(BS.decode_stream(RN.token_stream(spark, path, files), mode, **kw), name)
    parts = out.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("first_seq", "text"))).alias("p"))
    return turns.join(parts, "stream_id", "left").select(
        "conv_id", "turn", F.coalesce(F.array_join(F.transform("p", lambda x: x["text"]), ""), F.lit("")).alias("text"))


def q_stream_decode(spark: SparkSession, d: str) -> DataFrame:
    """ST-1 / ST-2: incremental UTF-8 decoding of byte streams cut into 3 micro-batches."""
    return _stream_text(spark, d, "decode", "utf8")


def q_stream_int(spark: SparkSession, d: str) -> DataFrame:
    """ST-3: bytes rendered as decimal integers, one space between items across batches."""
    return _stream_text(spark, d, "int", "int")


def q_stream_stop(spark: SparkSession, d: str) -> DataFrame:
    """ST-6: decoding stops after the first newline (the stop token is emitted)."""
    return _stream_text(spark, d, "stop", "utf8", eos_token=STREAM_EOS)


# every 11th token is moved past the bytes; one of the moved ids stops a stream
LIMITS = {"every": 11, "shift": 256, "eos": 256 + 101, "max_tokens": 200}


def _moved(tokens: DataFrame) -> DataFrame:
    p = LIMITS
    moved = (F.col("token") >= 0) & (F.pmod("seq", F.lit(p["every"])) == p["every"] - 1)
    return tokens.withColumn("token", F.when(moved, F.col("token") + p["shift"]).otherwise(F.col("token")))


def q_stream_limits(spark: SparkSession, d: str) -> DataFrame:
    """ST-4 .. ST-6 / PF-1: ids above 255 in the stream, a stop id above 255 and a token limit, printed as integers."""
    return _stream_text(spark, d, "limits", "int", _moved, eos_token=LIMITS["eos"], max_tokens=LIMITS["max_tokens"], ignore_overflowing=False)


def q_stream_overflow(spark: SparkSession, d: str) -> DataFrame:
    """ST-5: the same stream with the ids that are no bytes left out."""
    return _stream_text(spark, d, "overflow", "int", _moved, eos_token=LIMITS["eos"], max_tokens=LIMITS["max_tokens"])


def q_stream_top(spark: SparkSession, d: str) -> DataFrame:
    """ST-8: running 3 best validation losses per run over a log that arrives in files."""
    lg = R.by_kind(loss_log(spark, d), "valid").select(
        "run", "loss", "cum_batch", F.concat(F.lit("run"), F.col("run").cast("string")).alias("item"),
        F.pmod("cum_batch", F.lit(STREAM_CHUNKS)).alias("_part"),
    )
    path = RN.scratch(spark, "top-in")
    lg.repartition(STREAM_CHUNKS, "_part").drop("_part").write.parquet(path)
    src = spark.readStream.schema("run LONG, loss DOUBLE, cum_batch LONG, item STRING").option("maxFilesPerTrigger", 1).parquet(path)
    out = RN.run_available(BS.running_top_n(src, TOP_N), "top", mode="update")
    last = out.groupBy("run").agg(F.max("batch_id").alias("batch_id"))
    return out.join(last, ["run", "batch_id"]).select("run", F.col("rank").cast("bigint").alias("rank"), "cum_batch", "loss")


def q_metric_stream(spark: SparkSession, d: str) -> DataFrame:
    """ST-7: running per-(run, kind) counts of a loss log written as CSV files."""
    path = RN.scratch(spark, "log-in")
    lg = loss_log(spark, d).drop("run")
    lg = lg.withColumn("run", F.col("gpu_rank"))  # one log folder per worker rank
    LG.write_csv_log(lg.select(*[f.name for f in LG.LOSS_LOG.fields], "run").repartition(STREAM_CHUNKS), path)
    schema = LG.LOSS_LOG.add("run", "long")
    src = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", 1).csv(path)
    out = RN.run_available(RN.metric_counts(src, ["run"]), "metrics", mode="complete")
    last = out.agg(F.max("batch_id").alias("batch_id"))
    return out.join(last, "batch_id").select("run", "kind", "n_rows", dec("min_loss").alias("min_loss"), dec("last_loss").alias("last_loss"))


def q_rank_gate(spark: SparkSession, d: str) -> DataFrame:
    """IO-14: only the listed worker ranks (0 and 2) log; rows per run and kind."""
    return R.kind_counts(R.rank_gate(loss_log(spark, d), [0, 2]), ["run", "gpu_rank"])


def q_next_token_rows(spark: SparkSession, d: str) -> DataFrame:
    """W-18 on tall rows: one row per byte, the model input is the previous byte of the sequence."""
    c = table(spark, d, "conversations")
    rows = c.select("conv_id", "turn", F.posexplode(B.text_to_array("text")).alias("pos", "token"))
    out = PT.shift_right_rows(rows, ["conv_id", "turn"], "pos", "token", TOK.som_text)
    return out.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"),
                      F.col("token").cast("bigint").alias("token"), F.col("input").cast("bigint").alias("input"))


def q_raw_bytes(spark: SparkSession, d: str) -> DataFrame:
    """F-8 / ST-4 / ST-5: token rows (with an end marker) -> raw bytes -> one byte string per stream."""
    turns = numbered_turns(spark, d)
    raw = BS.raw_bytes(turn_tokens(turns))
    per = raw.groupBy("stream_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", F.decode("byte", "ISO-8859-1").alias("c")))).alias("p")
    )
    data = F.encode(F.coalesce(F.array_join(F.transform("p", lambda x: x["c"]), ""), F.lit("")), "ISO-8859-1")
    return turns.join(per, "stream_id", "left").select(
        "conv_id", "turn", F.octet_length(data).cast("bigint").alias("n_bytes"), F.hex(data).alias("hex"))


QUERIES = {
    "byte_windows": q_byte_windows,
    "byte_offsets": q_byte_offsets,
    "byte_windows_sharded": q_byte_windows_sharded,
    "byte_windows_tail": q_byte_windows_tail,
    "masked_windows": q_masked_windows,
    "text_bytes": q_text_bytes,
    "safe_decode": q_safe_decode,
    "replace_decode": q_replace_decode,
    "row_shards": q_row_shards,
    "random_windows": q_random_windows,
    "shuffle_order": q_shuffle_order,
    "epoch_plan": q_epoch_plan,
    "resume_plan": q_resume_plan,
    "budget": q_budget,
    "log_points": q_log_points,
    "batches": q_batches,
    "batches_eval": q_batches_eval,
    "shuffled_batches": q_shuffled_batches,
    "shuffled_batches_eval": q_shuffled_batches_eval,
    "kind_counts": q_kind_counts,
    "eval_mean": q_eval_mean,
    "last_loss": q_last_loss,
    "chain_check": q_chain_check,
    "top_checkpoints": q_top_checkpoints,
    "best_model": q_best_model,
    "running_elements": q_running_elements,
    "total_check": q_total_check,
    "first_k": q_first_k,
    "error_lines": q_error_lines,
    "run_summary": q_run_summary,
    "nan_losses": q_nan_losses,
    "lineage": q_lineage,
    "run_keys": q_run_keys,
    "window_ones": q_window_ones,
    "question_types": q_question_types,
    "first_records": q_first_records,
    "one_record": q_one_record,
    "jsonl_undo": q_jsonl_undo,
    "ce_loss": q_ce_loss,
    "topk_filter": q_topk_filter,
    "gumbel_sample": q_gumbel_sample,
    "patches": q_patches,
    "next_token_pairs": q_next_token_pairs,
    "tokenize_pad": q_tokenize_pad,
    "tokenize_crop": q_tokenize_crop,
    "qa_samples": q_qa_samples,
    "qa_image_samples": q_qa_image_samples,
    "crop": q_crop,
    "channel_bins": q_channel_bins,
    "dense_remap": q_dense_remap,
    "grayscale": q_grayscale,
    "chw": q_chw,
    "extend_embeddings": q_extend_embeddings,
    "rename_keys": q_rename_keys,
    "param_count": q_param_count,
    "answer_map": q_answer_map,
    "token_collisions": q_token_collisions,
    "byte_profile": q_byte_profile,
    "generation_quality": q_generation_quality,
    "stream_decode": q_stream_decode,
    "stream_int": q_stream_int,
    "stream_stop": q_stream_stop,
    "stream_limits": q_stream_limits,
    "stream_overflow": q_stream_overflow,
    "stream_top": q_stream_top,
    "metric_stream": q_metric_stream,
    "rank_gate": q_rank_gate,
    "next_token_rows": q_next_token_rows,
    "raw_bytes": q_raw_bytes,
}
