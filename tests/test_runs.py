import random

from pyspark.sql import functions as F

from bytelane.operators import runs as R
from bytelane.sources import logs as LG


def test_top_n_ties_keep_first(spark):
    df = spark.createDataFrame([(2.0, "2a", 0), (3.0, "3", 1), (1.0, "1", 2), (2.0, "2b", 3)], "v DOUBLE, item STRING, seq INT")
    df = df.withColumn("g", F.lit(0))
    got = [r.item for r in R.top_n(df, ["g"], "v", 3, seq="seq").orderBy("rank").collect()]
    assert got == ["1", "2a", "2b"]
    big = [r.item for r in R.top_n(df, ["g"], "v", 2, largest=True, seq="seq").orderBy("rank").collect()]
    assert big == ["3", "2a"]
    assert R.top_n(df, ["g"], "v", 0).count() == 0


def test_best_checkpoints_and_best_model(spark):
    df = spark.createDataFrame(
        [(1, 0.5, 10), (1, 0.2, 20), (1, 0.2, 5), (2, 0.9, 1)], "run INT, loss DOUBLE, cum_batch INT"
    ).withColumn("m", F.lit("model"))
    t = R.best_checkpoints(df, ["run"], 2, "m").orderBy("run", "rank").collect()
    assert [(r.run, r.cum_batch, r.checkpoint) for r in t] == [(1, 5, "model_top1"), (1, 20, "model_top2"), (2, 1, "model_top1")]
    b = {r.run: (r.best_cum_batch, r.best_loss) for r in R.best_model(df, ["run"]).collect()}
    assert b == {1: (5, 0.2), 2: (1, 0.9)}


def stack_replay(ops):
    stack = []
    for seq, op in ops:
        if op == "put":
            stack.append(seq)
        elif stack:
            stack.pop()
    return stack


def test_jsonl_undo_matches_stack_replay(spark):
    rnd = random.Random(7)
    rows, expected = [], set()
    for w in range(40):
        ops = [(i, rnd.choice(["put", "put", "undo"])) for i in range(30)]
        rows += [(w, s, o) for s, o in ops]
        expected |= {(w, s) for s in stack_replay(ops)}
    df = spark.createDataFrame(rows, "writer_id INT, seq INT, op STRING")
    for chunk in (65_536, 7, 1):  # one chunk per writer, several, one row per chunk
        got = {(r.writer_id, r.seq) for r in LG.jsonl_view(df, chunk=chunk).collect()}
        assert got == expected, chunk


def test_error_lines_keep_dashes_in_message(spark):
    lines = spark.createDataFrame(
        [("2024-01-01 - trainer - ERROR - loss - nan at batch 3",), ("2024-01-01 - trainer - INFO - ok",), ("t - x - CRITICAL - boom",)],
        "value STRING",
    )
    got = sorted((r.level, r.message) for r in R.error_lines(lines).collect())
    assert got == [("CRITICAL", "boom"), ("ERROR", "loss - nan at batch 3")]


def test_run_key_and_artefacts(spark):
    paths = spark.createDataFrame(
        [("/out/my-model_grad_acc_2/loss.csv",), ("/out/my-model_grad_acc_2/my-model_top1.pth",), ("/out/my-model_7/timemem.csv",)],
        "path STRING",
    )
    keyed = paths.withColumn("run", R.run_key_from_path("path", "my-model"))
    assert sorted({r.run for r in keyed.collect()}) == ["7", "grad_acc_2"]
    conf = spark.createDataFrame([("grad_acc_2", 1), ("7", 2), ("gone", 0)], "run STRING, num_models_to_save INT")
    lines = spark.createDataFrame([("7", "t - x - ERROR - a - b"), ("7", "t - x - INFO - fine")], "run STRING, value STRING")
    a = {r.run: (r.n_checkpoints, r.checkpoints_ok, r.has_loss_csv, r.n_errors) for r in R.artefact_check(keyed, "run", conf, lines).collect()}
    assert a == {"grad_acc_2": (1, True, True, 0), "7": (0, False, False, 1), "gone": (0, True, False, 0)}


def test_chain_and_running_total(spark):
    ext = spark.createDataFrame(
        [(0, 0, 99, 0, 800), (1, 100, 199, 1, 800), (2, 150, 160, 1, 10)],
        "run INT, min_cum_batch INT, max_cum_batch INT, max_epoch INT, sum_elements INT",
    )
    c = {r.run: (r.starts_after_prev, r.same_elements, r.next_epoch) for r in R.chain_check(ext, "run").collect()}
    assert c[1] == (True, True, True) and c[2] == (False, False, False) and c[0] == (None, None, None)
    rows = [(g, i, v) for g in (0, 3) for i, v in enumerate([5, 1, 4])]
    df = spark.createDataFrame(rows, "g INT, o INT, v INT")
    got = sorted((r.g, r.o, r.rt) for r in R.running_total(df, "g", "o", "v", "rt").collect())
    assert got == [(0, 0, 5), (0, 1, 6), (0, 2, 10), (3, 0, 5), (3, 1, 6), (3, 2, 10)]


def test_csv_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(0, None, 8, "train", 0, 0, 0, 1.5, 0.1, -1.0, -1.0)], LG.LOSS_LOG
    ).withColumn("timestamp", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    LG.write_csv_log(df, str(tmp_path / "run_1"))
    back = LG.read_csv_log(spark, str(tmp_path / "run_1")).first()
    assert back.kind == "train" and back.loss == 1.5 and back.file_path.endswith(".csv")
    LG.write_csv_log(df, str(tmp_path / "none"), noop=True)
    assert R.valid_iso(F.lit("2024-01-01T10:00:00")) is not None
    iso = spark.range(1).select(R.valid_iso(F.lit("2024-01-01T10:00:00")).alias("a"), R.valid_iso(F.lit("nope")).alias("b")).first()
    assert iso.a is True and iso.b is False


def test_rank_gate_nan_rows_and_loss_mask(spark):
    from bytelane.operators import windows as W

    log = spark.createDataFrame(
        [(0, float("nan"), "train"), (1, 0.5, "train"), (2, 0.7, "valid")], "gpu_rank INT, loss DOUBLE, kind STRING"
    )
    assert sorted(r.gpu_rank for r in R.rank_gate(log, [0, 2]).collect()) == [0, 2]
    assert R.rank_gate(log, None).count() == 3
    assert [r.gpu_rank for r in R.nan_losses(log).collect()] == [0]
    assert R.by_kind(log, "valid").count() == 1
    w = spark.createDataFrame([(0, 0, bytes([1, 2, 3]))], "worker INT, idx BIGINT, tokens BINARY")
    r = W.with_loss_mask(w).first()
    assert r.token_ids == [1, 2, 3] and r.loss_mask == [1.0, 1.0, 1.0]


def test_seeded_shuffles_are_permutations(spark):
    from bytelane.operators import qa as QA

    q = spark.range(50).select(F.col("id").alias("idx"))
    a = [r.idx for r in QA.iter_records(q, shuffle=True, seed=1).collect()]
    b = [r.idx for r in QA.iter_records(q, shuffle=True, seed=1).collect()]
    c = [r.idx for r in QA.iter_records(q, shuffle=True, seed=2).collect()]
    assert sorted(a) == list(range(50)) and a == b and a != c
    assert [r.idx for r in QA.iter_records(q, max_items=3).collect()] == [0, 1, 2]


def test_running_total_keeps_rows_that_share_an_order_value(spark):
    rows = [(1, 10, 0, 10), (1, 10, 1, 20), (1, 2**40, 0, 5), (2, 5, 0, 20), (None, 1, 0, 7), (1, 11, 0, None)]
    df = spark.createDataFrame(rows, "run LONG, cum LONG, rank INT, v LONG")
    got = sorted((str(r.run), r.cum, r["rank"], r.rt) for r in R.running_total(df, "run", "cum", "v", "rt", ties=["rank"]).collect())
    assert got == [("1", 10, 0, 10), ("1", 10, 1, 30), ("1", 11, 0, 30), ("1", 2**40, 0, 35), ("2", 5, 0, 20), ("None", 1, 0, 7)]


def test_lineage_of_long_chains_orphans_and_circles(spark):
    import pytest

    n = 70
    rows = [(i, f"c{i}", f"c{i - 1}" if i else None) for i in range(n)] + [(500, "x", "lost"), (501, None, "x")]
    df = spark.createDataFrame(rows, "run_id LONG, checkpoint_file STRING, resumed_from STRING")
    got = {r.run_id: (r.root_run, r.depth, r.orphan) for r in R.resume_lineage(df).collect()}
    assert got == {**{i: (0, i, False) for i in range(n)}, 500: (500, 0, True), 501: (500, 1, False)}
    circle = spark.createDataFrame([(1, "a", "b"), (2, "b", "a")], "run_id LONG, checkpoint_file STRING, resumed_from STRING")
    with pytest.raises(ValueError):
        R.resume_lineage(circle).collect()


def test_kind_counts_against_configured_amounts(spark):
    log = spark.createDataFrame([(1, "train"), (1, "train"), (1, "valid"), (2, "test")], "run LONG, kind STRING")
    conf = spark.createDataFrame([(1, "train", 2), (1, "valid", 2), (2, "train", 1)], "run LONG, kind STRING, expected LONG")
    got = {(r.run, r.kind): r.matches for r in R.kind_count_check(log, "run", conf).collect()}
    assert got == {(1, "train"): True, (1, "valid"): False, (2, "train"): False, (2, "test"): False}


def test_last_value_takes_any_kind(spark):
    log = spark.createDataFrame([(1, "train", 1, 5, 1.0), (1, "test", 2, 5, 9.0)], "run LONG, kind STRING, timestamp LONG, cum_batch LONG, loss DOUBLE")
    assert R.last_value(log, ["run"]).first().last_loss == 9.0
    assert R.last_value(log, ["run"], kind="train").first().last_loss == 1.0
