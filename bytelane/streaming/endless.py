"""An endless stream of random windows (W-7).

`operators.windows.random_windows` makes k draws. Here the draws never end:
draw n has the start that the seed and n give, so the first k draws are the
same windows, whenever and in however many runs they were made. The numbers
come from Spark's `rate-micro-batch` source, which replays a batch as it was;
each batch is written to a folder of its own, so a repeated one leaves its rows
once.

A window is read where it lies in the files: its start meets the one or few
files that overlap it in an equi-join on stretches of the corpus (`STRETCH`
bytes or the mean file, whichever is more, so the file table has at most about
two rows a file), and each piece is a seek and a read of its bytes. The work of
a batch is that of its draws, not of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bytelane.functions.hashing import uniform_int
from bytelane.operators.offsets import prefix_sum
from bytelane.session import written
from bytelane.sources.ranges import list_ranges, open_file, read_at
from bytelane.streaming.runner import batch_sink

STRETCH = 1 << 20


class WindowStore:
    """Files in the order of their paths as one corpus, open to reads at any place."""

    def __init__(self, spark: SparkSession, path: str, glob: str | None = None):
        files = list_ranges(spark, path, (1 << 31) - 1, glob).where("number = 0").select("path", "file_length")
        sums, totals = prefix_sum(files, "path", "file_length", "start")
        self.total = totals.total
        self.stretch = max(STRETCH, totals.total // max(totals.rows, 1))
        g = F.lit(self.stretch).cast("long")
        end = F.col("start") + F.col("_value")
        sums = sums.where("_value > 0").select(
            "path", F.col("start").alias("file_start"), end.alias("file_end"),
            F.explode(F.sequence(F.call_function("div", F.col("start"), g), F.call_function("div", end - 1, g))).alias("stretch"))
        self.files = written(sums, "window-store")
        totals.release()

    def read(self, draws: DataFrame, seq_len: int, keys: list[str]) -> DataFrame:
        """`(*keys, start, tokens)` for rows `(*keys, start)`, each window whole."""
        g = F.lit(self.stretch).cast("long")
        a, b = F.col("start"), F.col("start") + F.lit(seq_len)
        asked = draws.withColumn("stretch", F.explode(F.sequence(F.call_function("div", a, g), F.call_function("div", b - 1, g))))
        lo, hi = F.greatest(a, F.col("file_start")), F.least(b, F.col("file_end"))
        # a file and a window may meet in several stretches: the first of them counts
        pieces = asked.join(self.files, "stretch").where((lo < hi) & (F.call_function("div", lo, g) == F.col("stretch"))).select(
            *keys, "start", "path", (lo - F.col("file_start")).alias("at"), (hi - lo).alias("size"), (lo - a).alias("_order"))
        names = [*keys, "start", "_order"]
        kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for path, at, size in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "size")), strict=True):
                    with open_file(path) as file:
                        found.append(read_at(file, at, size))
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found, pa.binary())], names=[*names, "piece"])

        read = pieces.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", piece binary")
        whole = read.groupBy(*keys, "start").agg(F.sort_array(F.collect_list(F.struct("_order", "piece"))).alias("p"))
        text = F.array_join(F.transform("p", lambda p: F.decode(p["piece"], "ISO-8859-1")), "")
        return whole.select(*keys, "start", F.encode(text, "ISO-8859-1").alias("tokens"))

    def draws(self, numbers: DataFrame, seq_len: int, seed: int, hash_mode: str = "xxhash64") -> DataFrame:
        """`(draw, start)`: the start of each draw number, uniform in [0, total - seq_len - 1]."""
        if self.total - seq_len - 1 < 0:
            raise ValueError("corpus shorter than one window")
        return numbers.select("draw", uniform_int(F.lit(seed), F.col("draw"), upper=self.total - seq_len, mode=hash_mode).alias("start"))


def endless_windows(
    store: WindowStore, spark: SparkSession, out: str, checkpoint: str, seq_len: int, *, seed: int = 0, hash_mode: str = "xxhash64",
    draws_per_batch: int = 1000, trigger: dict | None = None,
) -> StreamingQuery:
    """Start writing `(draw, start, tokens)` below `out`, `draws_per_batch` at a time, until the query is stopped.

    Started again with the same checkpoint it goes on with the next draw.
    `trigger` is that of the stream writer; `{"availableNow": True}` makes one
    batch.
    """
    sink = batch_sink(out)

    def make(batch: DataFrame, batch_id: int) -> None:
        numbers = batch.select(F.col("value").alias("draw"))
        sink(store.read(store.draws(numbers, seq_len, seed, hash_mode), seq_len, ["draw"]), batch_id)

    numbers = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", draws_per_batch).load()
    return numbers.writeStream.foreachBatch(make).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
