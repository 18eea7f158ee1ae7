"""Training-run analytics over loss / time logs (A-1 .. A-10, A-16, A-17, J-5 .. J-7,
PF-2, PF-3, PF-6, PF-7, T-1 .. T-4, T-7, IO-14, IO-22).

Log schemas follow the reference's CSV rows (see `sources/logs.py`). Every
operator is a plain aggregation or a bounded window; per-run tops use
`row_number() <= n`, which Spark executes with a per-partition group limit
before the shuffle, so a run holding most rows still ships only n rows per
map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytelane.operators.offsets import global_row_index, join_small_or_shuffle, prefix_sum
from bytelane.session import ensure_checkpoint_dir

LOG_LEVELS_BAD = ("ERROR", "CRITICAL")


def by_kind(log: DataFrame, kind: str) -> DataFrame:
    """PF-2."""
    return log.where(F.col("kind") == kind)


def rank_gate(log: DataFrame, ranks: list[int] | None) -> DataFrame:
    """IO-14: keep rows of the listed worker ranks (None = all)."""
    return log if ranks is None else log.where(F.col("gpu_rank").isin(ranks))


def nan_losses(log: DataFrame) -> DataFrame:
    """PF-6."""
    return log.where(F.isnan("loss"))


def kind_counts(log: DataFrame, group: list[str]) -> DataFrame:
    """A-6: rows per (group, kind)."""
    return log.groupBy(*group, "kind").agg(F.count(F.lit(1)).alias("n_rows"))


def eval_mean(log: DataFrame, group: list[str], max_eval_steps: int | None, kind: str = "valid") -> DataFrame:
    """A-1: mean of per-batch losses over the first min(max_eval_steps, n) batches.

    Each batch counts once whatever its size (Q10). `None`/0 = all batches.
    """
    rows = log.where(F.col("kind") == kind)
    if max_eval_steps:
        rows = rows.where(F.col("batch") < F.lit(max_eval_steps))
    return rows.groupBy(*group).agg(
        F.avg("loss").alias("eval_loss"), F.count(F.lit(1)).alias("eval_batches")
    )


def eval_time(
    timelog: DataFrame, log: DataFrame, group: list[str], max_eval_steps: int | None, kind: str = "valid", run: str = "run"
) -> DataFrame:
    """A-2: total forward time of the evaluation batches that A-1 averages.

    The time log has no batch number: its rows are matched with the loss rows
    of the same run, kind and cumulative batch, which carry the bound.
    """
    rows = log.where(F.col("kind") == kind)
    if max_eval_steps:
        rows = rows.where(F.col("batch") < F.lit(max_eval_steps))
    keys = rows.select(*dict.fromkeys([run, *group, "cum_batch"])).distinct()
    times = timelog.where(F.col("kind") == kind).select(run, "cum_batch", "fw_time")
    return times.join(keys, [run, "cum_batch"]).groupBy(*group).agg(F.sum("fw_time").alias("eval_seconds"))


def run_extents(log: DataFrame, group: list[str], kind: str = "train") -> DataFrame:
    """A-7 / A-8: first and last cumulative batch, last epoch, elements seen."""
    return log.where(F.col("kind") == kind).groupBy(*group).agg(
        F.min("cum_batch").alias("min_cum_batch"),
        F.max("cum_batch").alias("max_cum_batch"),
        F.max("epoch").alias("max_epoch"),
        F.sum("elements_seen").alias("sum_elements"),
    )


def last_value(log: DataFrame, group: list[str], value: str = "loss", digits: int = 3, kind: str | None = None) -> DataFrame:
    """A-9: value of the latest row of any kind (by timestamp, then cum_batch), rounded.

    `kind` restricts it to one kind of row.
    """
    rows = log if kind is None else by_kind(log, kind)
    return rows.groupBy(*group).agg(
        F.round(F.max_by(value, F.struct("timestamp", "cum_batch")), digits).alias("last_" + value)
    )


def chain_check(extents: DataFrame, run_no: str) -> DataFrame:
    """J-5: run i+1 continues run i: start = previous max + 1, equal element sums, epoch + 1.

    Runs are numbered densely and each meets its predecessor by number, so no
    task sees them all.
    """
    pairs = with_previous(extents, run_no, ["max_cum_batch", "sum_elements", "max_epoch"])
    return pairs.select(
        run_no,
        "min_cum_batch",
        "max_cum_batch",
        (F.col("min_cum_batch") == F.col("prev_max_cum_batch") + 1).alias("starts_after_prev"),
        (F.col("sum_elements") == F.col("prev_sum_elements")).alias("same_elements"),
        (F.col("max_epoch") == F.col("prev_max_epoch") + 1).alias("next_epoch"),
    )


def with_previous(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows with the `values` of the row before them in `key` order, as `prev_*` (null for the first)."""
    keep = [c for c in rows.columns if c != key]
    indexed, _ = global_row_index(rows, key, "_at", keep=keep)
    before = indexed.select((F.col("_at") + 1).alias("_at"), *[F.col(v).alias("prev_" + v) for v in values])
    return indexed.join(before, "_at", "left").drop("_at")


def grad_acc_check(last: DataFrame, run_no: str, value: str = "last_loss") -> DataFrame:
    """J-7: adjacent runs end at the same rounded loss."""
    pairs = with_previous(last, run_no, [value])
    return pairs.select(run_no, value, (F.col(value) == F.col("prev_" + value)).alias("equal_to_prev"))


def top_n(
    df: DataFrame, group: list[str], value: str, n: int, *, largest: bool = False, seq: str | None = None
) -> DataFrame:
    """T-1 / T-2: the n best rows per group, ranked 1..n; ties go to the earlier `seq` (Q9).

    n = 0 keeps nothing (a no-op queue); `get_top(0)`/`None` in the reference
    return all kept items, which is `n` here.
    """
    if n <= 0:
        return df.limit(0).withColumn("rank", F.lit(0))
    order = [F.col(value).desc() if largest else F.col(value).asc()]
    if seq:
        order.append(F.col(seq).asc())
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def best_checkpoints(
    valid: DataFrame, group: list[str], n: int, model_name: Column | str, *, candidates: DataFrame | None = None
) -> DataFrame:
    """T-3: keep the n best checkpoints by validation loss, named `{model}_top{rank}`.

    `candidates` (same columns) adds the model a resumed run started from.
    """
    rows = valid if candidates is None else valid.unionByName(candidates)
    ranked = top_n(rows, group, "loss", n, seq="cum_batch")
    name = F.col(model_name) if isinstance(model_name, str) else model_name
    return ranked.withColumn("checkpoint", F.concat(name, F.lit("_top"), F.col("rank").cast("string")))


def best_model(valid: DataFrame, group: list[str]) -> DataFrame:
    """T-4: the single best row per group (partial aggregation, skew-safe)."""
    return valid.groupBy(*group).agg(
        F.min_by(F.struct("cum_batch", "loss"), F.struct("loss", "cum_batch")).alias("best")
    ).select(*group, F.col("best.cum_batch").alias("best_cum_batch"), F.col("best.loss").alias("best_loss"))


def running_total(
    df: DataFrame, group: str, order: str, value: str, out: str, *, ties: list[str] | None = None
) -> DataFrame:
    """A-16: running sum of `value` per group in `order` (then `ties`), without one task per group.

    The rows are summed globally in (group, order, ties) order by the bucketed
    prefix sum, which splits a group or an order value of any size, and the
    sum at the group's start is taken off. All other columns are carried
    along, so rows that share an order value stay the rows they are.
    """
    ties = ties or []
    keep = [c for c in df.columns if c not in {group, order, *ties}]
    sums, totals = prefix_sum(df, group, F.coalesce(F.col(value), F.lit(0)), "_before", tiebreak=[order, *ties], keep=keep)
    base = sums.groupBy(F.col(group).alias("_group")).agg(F.min("_before").alias("_base"), F.count(F.lit(1)).alias("_n"))
    # there are no more groups than rows, whose number is known; for more rows the engine decides by the groups' actual size
    joined = sums.join(F.broadcast(base) if totals.rows <= 500_000 else base, sums[group].eqNullSafe(F.col("_group")))
    return joined.select(*df.columns, (F.col("_before") - F.col("_base") + F.col("_value")).alias(out))


def total_check(log: DataFrame, group: list[str], value: str, expected: Column) -> DataFrame:
    """A-16: elements seen in the end against the expected total; `delta` = seen - expected."""
    return log.groupBy(*group).agg(F.sum(value).alias("seen"), F.max(expected).cast("bigint").alias("expected")).withColumn(
        "delta", F.col("seen") - F.col("expected")).withColumn("reached", F.col("delta") >= 0)


def parse_log_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """PF-3: `time - name - LEVEL - message`; the message may itself hold ' - '."""
    parts = F.split(F.col(text), " - ", 4)
    return lines.select(
        F.element_at(parts, 1).alias("time"),
        F.element_at(parts, 2).alias("logger"),
        F.element_at(parts, 3).alias("level"),
        F.element_at(parts, 4).alias("message"),
    )


def error_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """PF-3: keep ERROR and CRITICAL lines."""
    return parse_log_lines(lines, text).where(F.col("level").isin(*LOG_LEVELS_BAD))


def valid_iso(col: Column | str) -> Column:
    """PF-7: the string parses as an ISO timestamp."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(c).isNotNull()


def run_summary(log: DataFrame, group: list[str], params: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """A-17: start, end, number of workers, rows, and whether a NaN loss occurred.

    `params` (group, n_params) adds the model's size; `errors` (group, time,
    message) the first error text of each run, if any.
    """
    out = log.groupBy(*group).agg(
        F.min("timestamp").alias("started"),
        F.max("timestamp").alias("ended"),
        (F.max("gpu_rank") + 1).alias("workers"),
        F.count(F.lit(1)).alias("n_rows"),
        F.bool_or(F.isnan("loss")).alias("had_nan"),
    )
    if params is not None:
        out = out.join(params.select(*group, "n_params"), group, "left")
    if errors is not None:
        first = errors.groupBy(*group).agg(F.min_by("message", F.struct("time", "message")).alias("error"))
        out = out.join(first, group, "left")
    return out


def run_key_from_path(path: Column | str, name_model: str) -> Column:
    """IO-22: run id from an artefact path `.../{name_model}_{run_id}/file`.

    The known model-name prefix is stripped (run ids may contain '_').
    """
    p = F.col(path) if isinstance(path, str) else path
    parent = F.element_at(F.split(p, "/"), -2)
    prefix = name_model + "_"
    return F.when(parent.startswith(prefix), F.substring(parent, len(prefix) + 1, 1 << 30))


# fixed values: files that every run leaves behind
REQUIRED_FILES = {"loss_csv": "loss.csv", "config": "config.yaml", "train_log": "train.log"}


def artefact_check(listing: DataFrame, run: str, configs: DataFrame, log_lines: DataFrame | None = None) -> DataFrame:
    """A-10: files of each run against its own configuration.

    `configs` (run, num_models_to_save) has one row per run; runs without any
    file are reported too. `log_lines` (run, value) adds the number of error
    lines in the run's train log.
    """
    name = F.element_at(F.split("path", "/"), -1)
    found = listing.groupBy(run).agg(
        F.count_if(name.endswith(".pth")).alias("n_checkpoints"),
        *[F.bool_or(name == file).alias(f"has_{label}") for label, file in REQUIRED_FILES.items()],
    )
    has = [f"has_{label}" for label in REQUIRED_FILES]
    out = configs.join(found, run, "left").fillna(0, ["n_checkpoints"]).fillna(False, has)
    out = out.withColumn("checkpoints_ok", F.col("n_checkpoints") == F.col("num_models_to_save"))
    if log_lines is not None:
        bad = error_lines_of(log_lines, run).groupBy(run).agg(F.count(F.lit(1)).alias("n_errors"))
        out = out.join(bad, run, "left").fillna(0, ["n_errors"])
    return out


def error_lines_of(lines: DataFrame, run: str, text: str = "value") -> DataFrame:
    """PF-3 with the run kept: `(run, time, logger, level, message)` of bad lines."""
    parts = F.split(F.col(text), " - ", 4)
    names = ("time", "logger", "level", "message")
    parsed = lines.select(run, *[F.element_at(parts, i + 1).alias(n) for i, n in enumerate(names)])
    return parsed.where(F.col("level").isin(*LOG_LEVELS_BAD))


def kind_count_check(log: DataFrame, run: str, configured: DataFrame) -> DataFrame:
    """A-6: rows per run and kind against the configured amounts `(run, kind, expected)`."""
    counts = kind_counts(log, [run])
    out = configured.join(counts, [run, "kind"], "full").fillna(0, ["n_rows", "expected"])
    return out.withColumn("matches", F.col("n_rows") == F.col("expected"))


def resume_lineage(runs: DataFrame, run: str = "run_id", checkpoint: str = "checkpoint_file", parent: str = "resumed_from") -> DataFrame:
    """J-6: every run with the root run of its resume chain, its depth in it, and whether it is an orphan.

    Pointer doubling: each run points to the run whose checkpoint it resumed
    from, and each round doubles the length of all pointers by one equi-join,
    so a chain of n runs takes log2(n) rounds. A run whose pointer has reached
    a root is done and leaves the joins: only runs that still move are joined,
    with the few runs they can point to, so a root that very many runs go
    back to is no hot key. A run whose parent checkpoint isn't in the table is
    its own root and flagged. Of runs with one checkpoint name the least run id
    counts.
    """
    ensure_checkpoint_dir(runs.sparkSession)
    r = runs.select(F.col(run).alias("_run"), F.col(checkpoint).alias("_ckpt"), F.col(parent).alias("_parent"))
    owners = r.where(F.col("_ckpt").isNotNull()).groupBy(F.col("_ckpt").alias("_parent")).agg(F.min("_run").alias("_up"))
    linked = r.join(owners, "_parent", "left").select(
        "_run", F.coalesce("_up", "_run").alias("_up"), F.col("_up").isNotNull().cast("long").alias("_depth"),
        (F.col("_parent").isNotNull() & F.col("_up").isNull()).alias("orphan")).checkpoint()
    roots = linked.where("_depth = 0").select("_run", F.col("_run").alias("_up"), "_depth", "orphan")
    # `_at_root`: the pointer is a root; told by a flag, so nothing is joined to a root again
    state = linked.where("_depth > 0").join(roots.select(F.col("_run").alias("_up"), F.lit(True).alias("_at_root")), "_up", "left").select(
        "_run", "_up", "_depth", "orphan", F.coalesce("_at_root", F.lit(False)).alias("_at_root")).checkpoint()
    done = [roots]
    for _ in range(linked.count().bit_length() + 1):
        done.append(state.where("_at_root").drop("_at_root"))
        moving = state.where("not _at_root")
        if moving.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out.select(F.col("_run").alias(run), F.col("_up").alias("root_run"), F.col("_depth").alias("depth"), "orphan")
        # a pointer that is no root is that of a run in `state` or of one that was done in an earlier round
        known = state
        for d in done[1:-1]:
            known = known.unionByName(d.withColumn("_at_root", F.lit(True)))
        far = known.select(F.col("_run").alias("_up"), F.col("_up").alias("_next"), F.col("_depth").alias("_more"), F.col("_at_root").alias("_there"))
        state = moving.drop("_at_root").join(far, "_up").select(
            "_run", F.col("_next").alias("_up"), (F.col("_depth") + F.col("_more")).alias("_depth"), "orphan", F.col("_there").alias("_at_root")).checkpoint()
    raise ValueError("the resume chain runs in a circle")


def generation_quality(records: DataFrame, group: Sequence[str], truth: str = "truth", generated: str = "generated", ce: str = "ce") -> DataFrame:
    """A-18: per group the number of generations, mean cross entropy, exact matches and byte accuracy.

    `truth` and `generated` are arrays of byte values. Byte accuracy is the mean
    over the records of the share of the truth's bytes that the generation has
    at the same place; an empty truth counts as right if nothing was generated.
    Partial aggregation: one row a group and task is shuffled.
    """
    t, g = F.col(truth), F.col(generated)
    same = F.aggregate(F.zip_with(g, t, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))), F.lit(0), lambda n, x: n + x)
    share = F.when(F.size(t) == 0, (F.size(g) == 0).cast("double")).otherwise(same / F.size(t))
    return records.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(ce).alias("mean_ce"), F.avg((g == t).cast("double")).alias("exact_match"), F.avg(share).alias("byte_accuracy"))
