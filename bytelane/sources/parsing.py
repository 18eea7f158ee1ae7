"""Lines parsed by a user's function, with a quarantine (U-5).

`parse` gets one line and returns a tuple of the schema's fields; what it
raises sends the line to the quarantine instead of ending the job. A bad line
is reported with its file, its number in the file (from 1) and the error.

Files are read in blocks by many tasks, so no task knows how many lines stand
before its block. Each line carries its number in the block; the lines of a
file's earlier blocks are added from the blocks' counts, for bad lines only.
The parsed lines are written once, so that the function runs once a line.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from bytelane.session import written

LINE = "file string, block long, line long, error string, text string"


def parse_lines(spark: SparkSession, path: str, parse: Callable[[str], tuple], schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """`(good, bad)`: the parsed rows, and `(file, line, error, text)` of the lines that do not parse."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    kind = to_arrow_type(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            found = []
            for line, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[file, block] += 1
                found.append((file, block, seen[file, block], *_parsed(parse, line, kind)))
            files, blocks, lines, errors, texts, rows = zip(*found, strict=True) if found else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(files, pa.string()), pa.array(blocks, pa.int64()), pa.array(lines, pa.int64()), pa.array(errors, pa.string()),
                 pa.array(texts, pa.string()), pa.array(rows, kind)],
                names=["file", "block", "line", "error", "text", "row"])

    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    parsed = written(lines.mapInArrow(run, T.StructType([*T._parse_datatype_string(LINE).fields, T.StructField("row", fields)])), "lines")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = parsed.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("_before"))
    bad = parsed.where(F.col("error").isNotNull()).join(blocks, ["file", "block"])
    return parsed.where(F.col("error").isNull()).select("row.*"), bad.select("file", (F.col("line") + F.col("_before")).alias("line"), "error", "text")


def _parsed(parse: Callable[[str], tuple], line: bytes, kind: pa.StructType) -> tuple[str | None, str | None, dict | None]:
    """`(error, text, row)`: the row as Arrow takes it, or the error and the text; values of other types than the schema's are errors too."""
    try:
        values = parse(line.decode())
        if len(values) != kind.num_fields:
            raise ValueError(f"{len(values)} values for {kind.num_fields} fields")
        row = {kind.field(i).name: v for i, v in enumerate(values)}
        pa.scalar(row, kind)
        return None, None, row
    except Exception as e:  # the quarantine takes whatever the user's function raises
        return f"{type(e).__name__}: {e}", line.decode(errors="replace"), None


def require_good(bad: DataFrame) -> None:
    """Raise for the first bad line, naming file and line."""
    first = bad.orderBy("file", "line").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['file']}, line {first[0]['line']}: {first[0]['error']}")
