import pytest
from pyspark.sql import functions as F

from bytelane.plans import epochs as P


def cycler(lengths, start_epoch=0, start_batch=0, max_iters=None):
    """Plain-Python reading of the epoch cycler (brute force)."""
    out, epoch, n = [], start_epoch, 0
    if start_batch >= lengths(epoch):
        raise IndexError
    b0 = start_batch
    while True:
        L = lengths(epoch)
        for i in range(b0, L):
            if n == max_iters:
                return out
            nxt = (epoch + 1, 0) if i == L - 1 else (epoch, i + 1)
            out.append((epoch, i) + nxt)
            n += 1
        b0 = 0
        epoch += 1


def plan_rows(spark, lengths, **kw):
    p = P.epoch_plan(spark, lengths, **kw).orderBy("it").collect()
    assert [r.it for r in p] == list(range(len(p)))
    return [(r.epoch, r.batch, r.next_epoch, r.next_batch) for r in p]


@pytest.mark.parametrize("start", [(0, 0), (1, 3), (2, 3), (0, 1)])
def test_resume_constant_length(spark, start):
    L = P.constant_batches(5)
    assert plan_rows(spark, L, max_iters=12, start_epoch=start[0], start_batch=start[1]) == cycler(
        lambda e: 5, start[0], start[1], 12
    )


def test_max_iters(spark):
    L = P.constant_batches(5)
    for m in range(8):
        assert plan_rows(spark, L, max_iters=m) == cycler(lambda e: 5, max_iters=m)


def test_changing_length(spark):
    lens = {0: 2, 1: 1, 2: 3}
    L = P.EpochLengths(lambda e: lens.get(e % 3), lambda e: F.element_at(F.array(F.lit(2), F.lit(1), F.lit(3)), (F.pmod(e, F.lit(3)) + 1).cast("int")).cast("bigint"))
    assert plan_rows(spark, L, max_iters=11, period=3) == cycler(lambda e: lens[e % 3], max_iters=11)


def test_resume_error(spark):
    with pytest.raises(IndexError):
        P.epoch_plan(spark, P.constant_batches(5), max_iters=3, start_batch=5)


def test_budget_and_log_points(spark):
    b = P.budget(10_000, 4, 8, 1, "batch")
    assert (b.local_target, b.iters, b.expected_local, b.delta) == (2500, 313, 2504, 16)
    pts = sorted(r.point for r in P.log_points(spark, 10, 4, start=100).collect())
    assert pts == [100, 103, 106, 109]
    assert [r.point for r in P.log_points(spark, 3, 10).collect()] != []
    assert sorted(r.point for r in P.log_points(spark, 3, 10).collect()) == [0, 1, 2]
    assert [r.point for r in P.log_points(spark, 10, 1, start=7).collect()] == [7]


def test_batches_and_flags(spark):
    df = spark.range(11).select(F.col("id").alias("idx"))
    train = P.keep_full_batches(df, "idx", 11, 4, drop_last=True)
    assert sorted({r.batch for r in train.collect()}) == [0, 1]
    ev = P.keep_full_batches(df, "idx", 11, 4, drop_last=False)
    assert sorted({r.batch for r in ev.collect()}) == [0, 1, 2]
    flags = P.step_flags(spark.range(6).select(F.col("id").alias("batch")), 3).orderBy("batch").collect()
    assert [r.grad_step for r in flags] == [False, False, True, False, False, True]


def test_chained_runs_continue_each_other(spark):
    from bytelane.operators import runs as R

    L = P.constant_batches(10)
    runs, start, cum_end = [], (0, 0), -1
    for run_no, iters in enumerate([10, 15, 5]):
        plan = P.epoch_plan(spark, L, max_iters=iters, start_epoch=start[0], start_batch=start[1])
        rows = plan.orderBy("it").collect()
        assert rows[0].cum_batch == cum_end + 1  # resumes right after the previous run
        start, cum_end = (rows[-1].next_epoch, rows[-1].next_batch), rows[-1].cum_batch
        runs += [(run_no, r.cum_batch, r.epoch, 8) for r in rows]
    log = spark.createDataFrame(runs, "run INT, cum_batch BIGINT, epoch BIGINT, elements_seen INT").withColumn("kind", F.lit("train"))
    chk = {r.run: r for r in R.chain_check(R.run_extents(log, ["run"]), "run").collect()}
    assert chk[1].starts_after_prev and chk[2].starts_after_prev
    assert (chk[1].max_cum_batch, chk[2].min_cum_batch) == (24, 25)


def test_weighted_loss_identities(spark):
    from bytelane.functions import scoring as SC

    df = spark.createDataFrame([(0.5,), (0.0,), (2.0,)], "l DOUBLE")
    ones = df.agg(SC.nonzero_weighted_mean("l", F.lit(1.0))).first()[0]
    assert ones == pytest.approx((0.5 + 2.0) / 2)  # an exactly zero loss is dropped too (Q11)
    assert df.agg(SC.nonzero_weighted_mean("l", F.lit(0.0))).first()[0] == 0.0
