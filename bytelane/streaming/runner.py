"""Running streams to completion, and the metric-log stream (ST-7).

`run_available` drains a streaming DataFrame with `availableNow` into a
parquet table under the session's checkpoint folder (`spark.checkpoint.dir`,
the shared folder of the cluster) and returns that table as a batch
DataFrame. Sources are file folders; a token table can be laid out as a
stream of files with `write_token_files`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelane.session import scratch_path

TOKEN_SCHEMA = T.StructType(
    [
        T.StructField("stream_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("token", T.LongType()),
    ]
)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder."""
    return scratch_path(spark, f"bytelane-{name}")


ROWS_PER_FILE = 2_000_000


def write_token_files(tokens: DataFrame, path: str, chunks: int) -> int:
    """Lay out `(stream_id, seq, token)` rows in `chunks` parts: part c holds the
    c-th piece of every stream, so each micro-batch continues every stream.

    A part is as many files as its rows need; their number, the files of one
    micro-batch, is returned.
    """
    span = tokens.groupBy("stream_id").agg(F.max("seq").alias("_n"), F.count(F.lit(1)).alias("_rows")).persist()
    files = max(1, -(-(span.agg(F.sum("_rows")).first()[0] or 0) // (chunks * ROWS_PER_FILE)))
    t = tokens.join(span.drop("_rows"), "stream_id").withColumn(
        "_chunk", F.floor(F.col("seq") * F.lit(chunks) / (F.col("_n") + 1)).cast("int")
    )
    t = t.withColumn("_file", F.pmod(F.xxhash64("stream_id"), F.lit(files)).cast("int"))
    t.repartition(chunks * files, "_chunk", "_file").drop("_chunk", "_n", "_file").write.mode("overwrite").parquet(path)
    span.unpersist()
    return files


def token_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(TOKEN_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a streaming DataFrame (availableNow) into parquet; return the result table.

    Append mode writes with the file sink (exactly once through its log);
    update / complete modes go through `foreachBatch`, which gives each batch a
    folder of its own and overwrites it, so a replayed batch leaves its rows
    once; `batch_id` lets readers take the latest row per key.
    """
    spark = df.sparkSession
    out = scratch(spark, name)
    ckpt = out + "-checkpoint"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).outputMode("append")
    else:

        q = df.writeStream.foreachBatch(batch_sink(out)).option("checkpointLocation", ckpt).outputMode(mode)
    q.trigger(availableNow=True).start().awaitTermination()
    if mode == "append":
        return spark.read.parquet(out)
    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(out)


def batch_sink(out: str):
    """A `foreachBatch` function that writes each batch to its own folder of `out`, replays included."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return sink


def metric_counts(log_stream: DataFrame, group: list[str]) -> DataFrame:
    """ST-7: running rows / min loss / latest loss per (group, kind) of a growing log."""
    return log_stream.groupBy(*group, "kind").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("loss").alias("min_loss"),
        F.max_by("loss", "cum_batch").alias("last_loss"),
    )
