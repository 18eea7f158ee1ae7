"""Metric logs, CSV sinks and JSON lines (IO-10 .. IO-14).

Schemas are declared, never inferred; readers run in FAILFAST mode so that a
malformed row stops the job as the reference's strict models would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOSS_LOG = T.StructType(
    [
        T.StructField("gpu_rank", T.IntegerType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("elements_seen", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("batch", T.IntegerType()),
        T.StructField("cum_batch", T.LongType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("lr", T.DoubleType()),
        T.StructField("avg_grad", T.DoubleType()),
        T.StructField("avg_grad_clipped", T.DoubleType()),
    ]
)

TIME_LOG = T.StructType(
    [
        T.StructField("cum_batch", T.LongType()),
        T.StructField("num_items", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("fw_time", T.DoubleType()),
        T.StructField("bw_time", T.DoubleType(), True),
        T.StructField("allocated", T.DoubleType()),
        T.StructField("allocated_max", T.DoubleType()),
        T.StructField("reserved", T.DoubleType()),
        T.StructField("reserved_max", T.DoubleType()),
        T.StructField("total", T.DoubleType()),
    ]
)


def read_csv_log(spark: SparkSession, path: str, schema: T.StructType = LOSS_LOG) -> DataFrame:
    """IO-13: typed CSV log with a header row; `_metadata.file_path` gives the run (IO-22)."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "FAILFAST")
        .csv(path)
        .withColumn("file_path", F.col("_metadata.file_path"))
    )


def write_csv_log(df: DataFrame, path: str, *, append: bool = False, noop: bool = False) -> None:
    """IO-12: header once, overwrite at open or append; `noop` runs the plan and writes nothing.

    Spark's output commit protocol stands in for the reference's file lock:
    concurrent tasks write separate files that appear atomically on commit.
    """
    if noop:
        df.write.format("noop").mode("overwrite").save()
        return
    df.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """IO-10: JSON lines into a typed record (explicit schema, FAILFAST)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_view(ops: DataFrame, writer: str = "writer_id", seq: str = "seq", op: str = "op", chunk: int = 65_536) -> DataFrame:
    """IO-11: rows of an append log with undo that are still present.

    `op` is 'put' (a written row) or 'undo' (remove the last present row of the
    same writer; a no-op on an empty file). With cum = running (+1 put, -1
    undo) and height = cum - least(0, running min cum), a put at height h
    survives when no later row of the writer drops below h.

    Skew: a writer's log is cut into chunks of `chunk` consecutive sequence
    numbers (seq must be unique per writer). Windows run per chunk, so one
    writer with most of the rows still spreads over many tasks; only one
    summary row per chunk (net change, lowest running total, lowest height)
    is combined per writer, in a window over chunks.
    """
    d = F.when(F.col(op) == "put", 1).otherwise(-1)
    x = ops.withColumn("_d", d.cast("bigint")).withColumn("_c", F.floor(F.col(seq) / chunk).cast("bigint"))
    in_chunk = Window.partitionBy(writer, "_c").orderBy(seq)
    upto = in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("_lc", F.sum("_d").over(upto)).withColumn("_lmin", F.min("_lc").over(upto))

    # chunk summaries -> totals and minima of all earlier chunks of the writer
    summ = x.groupBy(writer, "_c").agg(F.sum("_d").alias("_D"), F.min("_lc").alias("_P"))
    before = Window.partitionBy(writer).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("_cb", F.coalesce(F.sum("_D").over(before), F.lit(0).cast("bigint")))
    summ = summ.withColumn("_mb", F.least(F.lit(0).cast("bigint"), F.coalesce(F.min(F.col("_cb") + F.col("_P")).over(before), F.lit(0).cast("bigint"))))
    x = x.join(summ.select(writer, "_c", "_cb", "_mb"), [writer, "_c"])
    cum = F.col("_cb") + F.col("_lc")
    low = F.least(F.col("_mb"), F.col("_cb") + F.col("_lmin"), F.lit(0).cast("bigint"))
    x = x.withColumn("_h", cum - low)

    # suffix minimum of the height: inside the chunk, then over later chunks
    after_in = in_chunk.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = x.withColumn("_hmin_in", F.min("_h").over(after_in))
    hsum = x.groupBy(writer, "_c").agg(F.min("_h").alias("_H"))
    later = Window.partitionBy(writer).orderBy("_c").rowsBetween(1, Window.unboundedFollowing)
    hsum = hsum.withColumn("_ha", F.min("_H").over(later))
    x = x.join(hsum.select(writer, "_c", "_ha"), [writer, "_c"])
    min_after = F.least(F.col("_hmin_in"), F.coalesce(F.col("_ha"), F.col("_hmin_in")))
    keep = (F.col(op) == "put") & (min_after >= F.col("_h"))
    return x.where(keep).select(*ops.columns)


# ---------------------------------------------------------------------------
# A loss / time log derived from the `events` table, used by the registered
# queries: the same per-row rule is spelled out in SQL by the oracles.
# fixed values: event type -> log kind
EVENT_KIND = {"purchase": "valid", "signup": "test", "view": "train", "click": "train", "error": "train"}
LOG_WORKERS = 4
ITEMS_PER_BATCH = 8
BATCHES_PER_EPOCH = 1000


def _kind(col: str) -> F.Column:
    expr = None
    for k, v in EVENT_KIND.items():
        expr = (F.when(F.col(col) == k, v) if expr is None else expr.when(F.col(col) == k, v))
    return expr.otherwise("train")


def loss_log_from_events(events: DataFrame) -> DataFrame:
    """One loss-log row per event: run = user, cum_batch = event id, loss = value."""
    return events.select(
        F.col("user_id").alias("run"),
        F.pmod("user_id", F.lit(LOG_WORKERS)).cast("int").alias("gpu_rank"),
        F.col("ts").alias("timestamp"),
        ((F.col("event_id") + 1) * ITEMS_PER_BATCH).alias("elements_seen"),
        _kind("event_type").alias("kind"),
        F.floor(F.col("event_id") / BATCHES_PER_EPOCH).cast("int").alias("epoch"),
        F.pmod("event_id", F.lit(BATCHES_PER_EPOCH)).cast("int").alias("batch"),
        F.col("event_id").alias("cum_batch"),
        F.col("value").alias("loss"),
        F.lit(-1.0).alias("lr"),
        F.lit(-1.0).alias("avg_grad"),
        F.lit(-1.0).alias("avg_grad_clipped"),
    )


def time_log_from_events(events: DataFrame) -> DataFrame:
    kind = _kind("event_type")
    return events.select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("cum_batch"),
        F.lit(ITEMS_PER_BATCH).cast("bigint").alias("num_items"),
        kind.alias("kind"),
        (F.col("value") / 100.0).alias("fw_time"),
        F.when(kind == "train", F.col("value") / 200.0).alias("bw_time"),
    )


def log_lines_from_events(events: DataFrame) -> DataFrame:
    """Text log lines `time - logger - LEVEL - message` (messages may contain ' - ')."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "CRITICAL").otherwise("INFO")
    return events.select(
        F.concat_ws(
            " - ",
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            F.lit("trainer"),
            level,
            F.concat(F.col("event_type"), F.lit(" - "), F.col("props")),
        ).alias("value")
    )
