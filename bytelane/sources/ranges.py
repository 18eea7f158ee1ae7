"""Files of any size as byte ranges (IO-1).

`binaryFile` puts a whole file into one row, which ends at 2 GB and gives a
large file to one task. Here a file is a table of ranges `(path, file, number,
start, length)`, made from the listing alone, and each range is read where its
row is: a task opens the file, seeks, and reads its bytes. Ranges cover a file
without gaps, so as documents of a corpus, in the order of `(path, start)`,
they give the same global offsets and the same windows as the whole file.

Paths of a local or mounted folder are opened directly; other schemes go
through `pyarrow.fs`, which knows object stores and HDFS. Compressed files
have no ranges and are read as their stored bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelane.operators.offsets import global_row_index, join_small_or_shuffle
from bytelane.sources.corpus import split_folder

RANGE_BYTES = 64 << 20
RANGE = "path string, number long, start long, length long, file_length long"


def open_file(path: str) -> BinaryIO:
    """A seekable input of a file that Spark's listing named."""
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return open(path.removeprefix("file:").replace("//", "/", 1) if scheme else path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(unquote(inner))


def read_at(file: BinaryIO, start: int, length: int) -> bytes:
    """Exactly `length` bytes from `start`; a file that has become shorter is an error."""
    file.seek(start)
    data = file.read(length)
    if len(data) != length:
        raise OSError(f"{length} bytes at {start} asked for, {len(data)} found: the file has changed")
    return bytes(data)


def list_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, glob: str | None = None) -> DataFrame:
    """The ranges of every file below `path`, from the listing; an empty file has one range of no bytes."""
    if not 0 < range_bytes < 1 << 31:
        raise ValueError("a range holds between 1 byte and 2 GB")
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", F.col("length").alias("file_length"))
    step = F.lit(range_bytes).cast("long")
    last = F.greatest(F.ceil(F.col("file_length") / step).cast("long") - 1, F.lit(0).cast("long"))
    ranges = files.select("path", "file_length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("number"))
    start = F.col("number") * step
    return ranges.select("path", "number", start.alias("start"), F.least(step, F.col("file_length") - start).alias("length"), "file_length")


def spread(ranges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Range rows dealt over the tasks that will read them; a range is a few bytes here."""
    return ranges.repartition(tasks or int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")), "path", "start")


def with_content(ranges: DataFrame) -> DataFrame:
    """The ranges with their bytes, one range of a task in memory at a time."""
    names = [f.name for f in ranges.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                with open_file(row.column("path")[0].as_py()) as file:
                    data = read_at(file, row.column("start")[0].as_py(), row.column("length")[0].as_py())
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], names=[*names, "content"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema.fields)
    return spread(ranges).mapInArrow(run, f"{kinds}, content binary")


def corpus_from_ranges(
    spark: SparkSession,
    root: str,
    split: str | None = "train",
    *,
    family: str = "books",
    glob: str | None = None,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """IO-1 without a limit of file size: each range is a document of the corpus.

    `doc_id` is the dense position in the order of path and start, computed
    from the listing; the contents are read last and are not shuffled. `name`
    is the file name, the same for all ranges of a file. `split=None` reads
    `root` itself.
    """
    ranges = list_ranges(spark, f"{root.rstrip('/')}/{split_folder(split, family)}" if split else root, range_bytes, glob)
    numbered, _ = global_row_index(ranges, "path", "doc_id", tiebreak=["start"], keep=["length"])
    return with_content(numbered).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.col("length").alias("n_bytes"))
