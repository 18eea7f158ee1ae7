"""Training plan tables: batches, epochs, resume, budget, log points (W-9 .. W-16, W-22, A-15, A-16).

A plan is an ordinary DataFrame with one row per training iteration; what
the reference computes step by step inside its loop becomes columns:

  it, epoch, batch, next_epoch, next_batch, n_batches, cum_batch,
  grad_step, elements_seen, is_log_point, is_valid_point

Epoch lengths may change from epoch to epoch (the window offset moves with
the epoch), so they are evaluated per epoch and never assumed constant.
Iterations are generated in chunks of at most `CHUNK` rows per task, so a
long epoch does not end up in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelane.operators.offsets import prefix_sum
from bytelane.operators.windows import ShardSpec

CHUNK = 65_536


@dataclass(frozen=True)
class EpochLengths:
    """Batches per epoch, as a driver function and the same rule as a column."""

    py: Callable[[int], int]
    col: Callable[[Column], Column]


def window_batches(spec: ShardSpec, batch_size: int, drop_last: bool = True) -> EpochLengths:
    """W-6 + W-9: batches of one worker in epoch e (offset = e mod L)."""
    S, L, B = spec.shard, spec.seq_len, batch_size

    def py(e: int) -> int:
        n = max((S - e % L) // L, 0)
        return n // B if drop_last else -(-n // B)

    def col(e: Column) -> Column:
        n = F.greatest(F.floor((F.lit(S) - F.pmod(e, F.lit(L))) / F.lit(L)), F.lit(0)).cast("bigint")
        return F.floor(n / B).cast("bigint") if drop_last else F.ceil(n / B).cast("bigint")

    return EpochLengths(py, col)


def constant_batches(n: int) -> EpochLengths:
    return EpochLengths(lambda e: n, lambda e: F.lit(n).cast("bigint"))


def batch_of(idx: Column | str, batch_size: int) -> Column:
    """W-9: batch number of a sample index."""
    i = F.col(idx) if isinstance(idx, str) else idx
    return F.floor(i / F.lit(batch_size)).cast("bigint")


def keep_full_batches(df: DataFrame, idx: str, n_items: int, batch_size: int, drop_last: bool) -> DataFrame:
    """W-9: training drops the last short batch; evaluation keeps it."""
    out = df.withColumn("batch", batch_of(idx, batch_size))
    if drop_last:
        out = out.where(F.col("batch") < F.lit(n_items // batch_size))
    return out


def collate(df: DataFrame, idx: str, payload: list[str], batch: str = "batch") -> DataFrame:
    """A-15: one row per batch with its samples ordered by index (a group holds B rows)."""
    return df.groupBy(batch).agg(
        F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), *[F.col(c) for c in payload]))).alias("items")
    )


def _epochs_needed(lengths: EpochLengths, start_epoch: int, start_batch: int, max_iters: int, period: int) -> int:
    first = lengths.py(start_epoch)
    if start_batch >= first:
        raise IndexError(f"epoch {start_epoch} has {first} batches, none numbered {start_batch}")
    done, e, idle = 0, start_epoch, 0
    while done < max_iters:
        n = lengths.py(e) - (start_batch if e == start_epoch else 0)
        done += max(n, 0)
        idle = idle + 1 if n <= 0 else 0
        if idle > period:
            raise ValueError("every epoch is empty: the plan would never reach max_iters")
        e += 1
    return max(e - start_epoch, 1)


def epoch_plan(
    spark: SparkSession,
    lengths: EpochLengths,
    *,
    max_iters: int,
    start_epoch: int = 0,
    start_batch: int = 0,
    period: int = 1,
) -> DataFrame:
    """W-11 / W-12 / W-13: one row per iteration, resumable at (start_epoch, start_batch).

    `period` bounds how many empty epochs in a row are tolerated before the
    plan is declared endless (the epoch length repeats with this period).
    """
    if max_iters < 0:
        raise ValueError("max_iters must be >= 0")
    n_epochs = _epochs_needed(lengths, start_epoch, start_batch, max_iters, period) if max_iters else 1
    ep = spark.range(start_epoch, start_epoch + n_epochs, numPartitions=max(1, min(n_epochs, 64))).select(
        F.col("id").alias("epoch")
    )
    ep = ep.withColumn("n_batches", lengths.col(F.col("epoch")))
    ep = ep.withColumn("first", F.when(F.col("epoch") == start_epoch, F.lit(start_batch)).otherwise(F.lit(0)).cast("bigint"))
    ep = ep.withColumn("todo", F.greatest(F.col("n_batches") - F.col("first"), F.lit(0)))
    before, _ = prefix_sum(ep, "epoch", "todo", "it0", keep=["n_batches", "first"])
    before = before.withColumnRenamed("_value", "todo").where(F.col("todo") > 0)
    chunks = before.select(
        "*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("todo") / F.lit(CHUNK)).cast("bigint") - 1)).alias("c")
    ).repartition("epoch", "c")
    rows = chunks.select(
        "epoch", "n_batches", "first", "it0",
        F.explode(
            F.sequence(F.col("c") * CHUNK, F.least((F.col("c") + 1) * CHUNK, F.col("todo")) - 1)
        ).alias("k"),
    )
    last = F.col("batch") == F.col("n_batches") - 1
    return (
        rows.select(
            (F.col("it0") + F.col("k")).alias("it"),
            "epoch",
            (F.col("first") + F.col("k")).alias("batch"),
            "n_batches",
        )
        .where(F.col("it") < F.lit(max_iters))
        .withColumn("next_epoch", F.when(last, F.col("epoch") + 1).otherwise(F.col("epoch")))
        .withColumn("next_batch", F.when(last, F.lit(0).cast("bigint")).otherwise(F.col("batch") + 1))
        .withColumn("cum_batch", F.col("n_batches") * F.col("epoch") + F.col("batch"))
    )


@dataclass(frozen=True)
class Budget:
    """W-14: the per-worker iteration budget for a target number of elements."""

    global_target: int
    workers: int
    elements_per_batch: int
    local_target: int
    iters: int
    expected_local: int
    expected_global: int
    delta: int


def budget(target_elements: int, workers: int, batch_size: int, seq_len: int, strategy: str = "sequence") -> Budget:
    if strategy not in ("batch", "sequence"):
        raise ValueError(f"unknown strategy {strategy!r}")
    local = target_elements // workers
    epb = batch_size if strategy == "batch" else batch_size * seq_len
    iters = math.ceil(local / epb)
    exp_local = epb * iters
    return Budget(target_elements, workers, epb, local, iters, exp_local, exp_local * workers, exp_local * workers - target_elements)


def budget_columns(target: Column, workers: int, batch_size: int, seq_len: int, strategy: str = "sequence") -> list[Column]:
    """W-14 as columns over a column of global targets."""
    local = F.floor(target / F.lit(workers)).cast("bigint")
    epb = F.lit(batch_size if strategy == "batch" else batch_size * seq_len).cast("bigint")
    iters = F.ceil(local / epb).cast("bigint")
    exp_local = epb * iters
    return [
        local.alias("local_target"),
        epb.alias("elements_per_batch"),
        iters.alias("iters"),
        exp_local.alias("expected_local"),
        (exp_local * F.lit(workers)).alias("expected_global"),
        (exp_local * F.lit(workers) - target).alias("delta"),
    ]


def log_points(spark: SparkSession, total_iters: int, amount: int, start: int = 0) -> DataFrame:
    """W-15: `amount` evenly spaced iteration ids in [start, start+total-1], truncated, distinct.

    The amount is clipped to the number of iterations. Exact integer
    arithmetic (the reference uses float32 `linspace`, which can differ by one
    for very long runs).
    """
    n = min(amount, total_iters)
    if n <= 0:
        return spark.range(0).select(F.col("id").alias("point"))
    if n == 1:
        return spark.range(1).select(F.lit(start).cast("bigint").alias("point"))
    pts = spark.range(n).select(
        (F.lit(start) + F.floor(F.col("id") * F.lit(total_iters - 1) / F.lit(n - 1))).cast("bigint").alias("point")
    )
    return pts.distinct()


def step_flags(plan: DataFrame, accumulate_every: int, batch: str = "batch") -> DataFrame:
    """W-16: optimizer step after every k-th batch of an epoch."""
    return plan.withColumn("grad_step", F.pmod(F.col(batch) + 1, F.lit(accumulate_every)) == 0)


def first_k(df: DataFrame, group: list[str], order: list[str], k: int = 30) -> DataFrame:
    """W-22: the first k rows per group (top-k per group; Spark limits each
    map partition to k rows per group before the shuffle)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def training_plan(
    spark: SparkSession,
    lengths: EpochLengths,
    *,
    iters: int,
    elements_per_batch: int,
    start_epoch: int = 0,
    start_batch: int = 0,
    accumulate_every: int = 1,
    log_amount: int = 1000,
    validate_amount: int = 100,
    period: int = 1,
) -> DataFrame:
    """The whole per-iteration plan of one worker.

    Log and validation points are spaced over cumulative batch ids starting at
    n_batches(start_epoch) * start_epoch + start_batch (Q16); a point the
    cumulative id never takes is never hit, as in the reference.
    """
    plan = step_flags(
        epoch_plan(spark, lengths, max_iters=iters, start_epoch=start_epoch, start_batch=start_batch, period=period),
        accumulate_every,
    )
    plan = plan.withColumn("elements_seen", (F.col("it") + 1) * F.lit(elements_per_batch))
    cum0 = lengths.py(start_epoch) * start_epoch + start_batch
    logs = log_points(spark, iters, log_amount, cum0).select(F.col("point").alias("cum_batch"), F.lit(True).alias("is_log_point"))
    vals = log_points(spark, iters, validate_amount, cum0).select(
        F.col("point").alias("cum_batch"), F.lit(True).alias("is_valid_point")
    )
    # both point sets hold at most `amount` rows (driver-side bound)
    plan = plan.join(F.broadcast(logs), "cum_batch", "left").join(F.broadcast(vals), "cum_batch", "left")
    return plan.withColumn("is_log_point", F.coalesce("is_log_point", F.lit(False))).withColumn(
        "is_valid_point", F.coalesce("is_valid_point", F.lit(False))
    )
