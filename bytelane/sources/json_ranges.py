"""One large JSON document read by many tasks (IO-6).

The document is an object with an array of records under some key. Its bytes
are read in ranges, without knowing what came before a range. Two passes find
the records:

1. Outline: each range says how many quotes it holds and, for both cases
   (it begins inside a string or not), how far it changes the nesting depth,
   the least depth it reaches, and at which depths objects open. Whether its
   first byte is escaped is settled by looking back over the backslashes.
2. Running totals over the ranges of a file (a few numbers a range) tell each
   range whether it begins in a string, and at which depth. Only the ranges
   that reach the top level (usually the first and the last) are read again, to
   see which arrays begin there.
3. Records: each range cuts out the records that begin in it, reading past its
   end until the last of them is closed, and numbers them from the totals of
   the ranges before it.

No task reads more than a range and the rest of one record. A file must be
plain (not compressed) JSON; one whose quotes or brackets don't match is an
error, and so is a record that does not parse.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelane.operators.offsets import prefix_sum
from bytelane.session import written
from bytelane.sources.ranges import RANGE_BYTES, list_ranges, open_file, read_at, spread

LOOK = 4096  # bytes read at once when looking beyond a range
ROWS = 1000  # records in one Arrow batch

_QUOTE, _BACKSLASH = 0x22, 0x5C
_STEP = np.zeros(256, np.int8)
_STEP[[0x7B, 0x5B]] = 1  # { [
_STEP[[0x7D, 0x5D]] = -1  # } ]


def _escaped_at(file: BinaryIO, start: int) -> bool:
    """Whether an odd number of backslashes stands right before `start`."""
    at, run = start, 0
    while at > 0:
        n = min(LOOK, at)
        data = read_at(file, at - n, n)
        kept = len(data.rstrip(b"\\"))
        run += n - kept
        if kept:
            break
        at -= n
    return run % 2 == 1


def _quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Places of the quotes that begin or end a string; `escaped`: the first byte follows an odd run of backslashes."""
    at = np.flatnonzero(data == _QUOTE)
    other = np.flatnonzero(data != _BACKSLASH)
    # the last byte before each quote that is no backslash
    before = np.searchsorted(other, at) - 1
    last = np.where(before >= 0, other[np.maximum(before, 0)], -1) if len(other) else np.full(len(at), -1)
    run = at - 1 - last + np.where(last < 0, int(escaped), 0)
    return at[run % 2 == 0]


def _brackets(data: np.ndarray, quotes: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """`(places, steps)` of the brackets outside strings, if the data begins inside a string or not."""
    step = _STEP[data]
    at = np.flatnonzero(step)
    free = (np.searchsorted(quotes, at) + int(inside)) % 2 == 0
    return at[free], step[at[free]].astype(np.int64)


CASE = "struct<delta:long,least:long,opens:array<struct<depth:long,n:long>>>"


def _case(data: np.ndarray, quotes: np.ndarray, inside: bool) -> dict:
    at, step = _brackets(data, quotes, inside)
    after = np.cumsum(step)
    depth, n = np.unique((after - 1)[data[at] == 0x7B], return_counts=True)
    return {"delta": int(step.sum()), "least": int(min(after.min(initial=0), 0)),
            "opens": [{"depth": int(d), "n": int(c)} for d, c in zip(depth, n, strict=True)]}


def _read(row: dict) -> tuple[BinaryIO, np.ndarray, np.ndarray]:
    file = open_file(row["path"])
    data = np.frombuffer(read_at(file, row["start"], row["length"]), np.uint8)
    return file, data, _quotes(data, _escaped_at(file, row["start"]))


def outline(ranges: DataFrame) -> DataFrame:
    """Step 1: `quotes` and, for either case, `free` and `quoted` of every range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file, data, quotes = _read(row)
                file.close()
                yield pa.RecordBatch.from_pylist(
                    [row | {"quotes": len(quotes), "free": _case(data, quotes, False), "quoted": _case(data, quotes, True)}], schema=kind)

    case = pa.struct([("delta", pa.int64()), ("least", pa.int64()), ("opens", pa.list_(pa.struct([("depth", pa.int64()), ("n", pa.int64())])))])
    names = [("path", pa.string()), ("number", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("file_length", pa.int64())]
    kind = pa.schema([*names, ("quotes", pa.int64()), ("free", case), ("quoted", case)])
    return spread(ranges).mapInArrow(run, f"path string, number long, start long, length long, file_length long, quotes long, free {CASE}, quoted {CASE}")


def placed(outlined: DataFrame) -> DataFrame:
    """Step 2: `inside` and `depth` at the start of every range; a file that does not come out even is an error."""
    w = Window.partitionBy("path").orderBy("number")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    d = outlined.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    d = d.withColumn("case", F.when(F.col("inside"), F.col("quoted")).otherwise(F.col("free"))).drop("free", "quoted")
    d = d.withColumn("depth", F.coalesce(F.sum("case.delta").over(before), F.lit(0).cast("long")))
    d = d.withColumn("_quotes", F.sum("quotes").over(whole)).withColumn("_depth", F.sum("case.delta").over(whole))
    d = d.withColumn("_least", F.min(F.col("depth") + F.col("case.least")).over(whole))
    even = F.assert_true((F.col("_quotes") % 2 == 0) & (F.col("_depth") == 0) & (F.col("_least") >= 0), F.concat(F.lit("no whole JSON document: "), F.col("path")))
    return d.where(even.isNull()).drop("_quotes", "_depth", "_least")


def _key_before(file: BinaryIO, at: int) -> str | None:
    """The key whose value begins at `at`."""
    size = LOOK
    while True:
        data = read_at(file, at - min(size, at), min(size, at)).rstrip()
        body = data[:-1].rstrip() if data.endswith(b":") else b""
        quotes = _quotes(np.frombuffer(body, np.uint8), _escaped_at(file, at - min(size, at)))
        if len(quotes) >= 2 and quotes[-1] == len(body) - 1:
            return json.loads(body[quotes[-2]:])
        if size >= at:
            return None
        size *= 2


def _cut(row: dict, key: str, data: np.ndarray, quotes: np.ndarray, file: BinaryIO) -> tuple[np.ndarray, np.ndarray, np.ndarray, str | None]:
    """`(places, steps, begins, key at the end)`: brackets of the range, and which of them begin a record."""
    at, step = _brackets(data, quotes, row["inside"])
    before = row["depth"] + np.cumsum(step) - step
    tops = np.flatnonzero((before == 1) & (data[at] == 0x5B))
    keys = [row["key"], *(_key_before(file, row["start"] + int(at[t])) for t in tops)]
    wanted = np.array([k == key for k in keys])
    begins = (before == 2) & (data[at] == 0x7B) & wanted[np.searchsorted(tops, np.arange(len(at)))]
    return at, step, begins, keys[-1]


def numbered(place: DataFrame, key: str) -> DataFrame:
    """The ranges with `key` (of the top-level array that is open at their start) and `idx` (number of their first record)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file, data, quotes = _read(row)
                with file:
                    # both answers for the array that is open already, which other ranges know
                    counts = [int(_cut(row | {"key": k}, key, data, quotes, file)[2].sum()) for k in (None, key)]
                    last = _cut(row | {"key": None}, key, data, quotes, file)[3]
                yield pa.RecordBatch.from_pydict(
                    {"path": [row["path"]], "number": [row["number"]], "other": [counts[0]], "own": [counts[1]], "last": pa.array([last], pa.string())})

    top = place.where(F.col("depth") + F.col("case.least") <= 1).select("path", "number", "start", "length", "inside", "depth")
    tops = spread(top).mapInArrow(run, "path string, number long, other long, own long, last string")
    # ranges that stay below the top level hold records of one array only
    in_range = F.aggregate(F.filter("case.opens", lambda o: o["depth"] + F.col("depth") == 2), F.lit(0).cast("long"), lambda a, o: a + o["n"])
    d = place.select("path", "number", "start", "length", "inside", "depth", in_range.alias("_n")).join(tops, ["path", "number"], "left")
    before = Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("key", F.last("last", ignorenulls=True).over(before))
    own = F.coalesce(F.col("key") == key, F.lit(False))
    d = d.withColumn("records", F.coalesce(F.when(own, F.col("own")).otherwise(F.col("other")), F.when(own, F.col("_n")).otherwise(F.lit(0))))
    sums, _ = prefix_sum(d, "path", "records", "idx", tiebreak=["number"], keep=["start", "length", "inside", "depth", "key"])
    return sums.withColumnRenamed("_value", "records")


def records(ranges: DataFrame, key: str) -> DataFrame:
    """Step 3: `(path, idx, position, record)`, one row for each record of the array under `key`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file, data, quotes = _read(row)
                with file:
                    found = []
                    for i, (position, text) in enumerate(_texts(row, key, data, quotes, file)):
                        found.append((row["path"], row["idx"] + i, position, text))
                        if len(found) == ROWS:
                            yield _rows(found)
                            found = []
                    if found:
                        yield _rows(found)

    return spread(ranges.where("records > 0")).mapInArrow(run, "path string, idx long, position long, record string")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    path, idx, position, text = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(path), pa.array(idx, pa.int64()), pa.array(position, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], names=["path", "idx", "position", "record"])


def _texts(row: dict, key: str, data: np.ndarray, quotes: np.ndarray, file: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """`(position in the file, bytes)` of the records that begin in the range."""
    at, step, begins, _ = _cut(row, key, data, quotes, file)
    after = row["depth"] + np.cumsum(step)
    ends = at[(after == 2) & (data[at] == 0x7D)]
    for begin in at[begins].tolist():
        e = np.searchsorted(ends, begin)
        yield row["start"] + begin, data[begin:ends[e] + 1].tobytes() if e < len(ends) else data[begin:].tobytes() + _rest(row, data, quotes, int(after[-1]), file)


def _rest(row: dict, data: np.ndarray, quotes: np.ndarray, depth: int, file: BinaryIO) -> bytes:
    """What follows the range up to the end of the record that is open at its end."""
    inside = (len(quotes) + int(row["inside"])) % 2 == 1
    at, size, out = row["start"] + row["length"], LOOK, []
    escaped = _escaped_at(file, at)
    while True:
        n = min(size, row["file_length"] - at)
        if n <= 0:
            raise ValueError(f"{row['path']} ends inside a record")
        more = np.frombuffer(read_at(file, at, n), np.uint8)
        q = _quotes(more, escaped)
        places, step = _brackets(more, q, inside)
        after = depth + np.cumsum(step)
        closed = places[(after == 2) & (more[places] == 0x7D)]
        if len(closed):
            return b"".join([*out, more[:closed[0] + 1].tobytes()])
        out.append(more.tobytes())
        at, size = at + n, size * 2
        depth += int(step.sum())
        inside ^= len(q) % 2 == 1
        escaped = _escaped_at(file, at)


def read_records(spark: SparkSession, path: str, schema: T.StructType, key: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the array under `key` of one or several JSON documents, parsed, with their 0-based index.

    The index runs on over the files in the order of their paths. Records are
    parsed where they are cut out, by as many tasks as there are ranges.
    """
    # a few numbers a range, written so that the bytes are not read again for them
    place = written(placed(outline(list_ranges(spark, path, range_bytes))), "outline")
    sums = numbered(place, key)
    lengths = place.select("path", "number", "file_length")
    cut = records(sums.join(lengths, ["path", "number"]), key)
    parsed = cut.select(F.col("idx").cast("int").alias("idx"), F.from_json("record", schema, {"mode": "FAILFAST"}).alias("q"))
    return parsed.select("idx", "q.*")


def document_lines(rows: DataFrame, record: str, order: list[str], info: str, key: str, partitions: int) -> DataFrame:
    """`(value)` lines of JSON documents with `record` (JSON text) rows in `order`, one document a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = f'{{"info": {info}, {json.dumps(key)}: ['
        comma = ""  # none after the opening line, nor after the last record
        for batch in batches:
            out = []
            for text in batch.column("record").to_pylist():
                out.append(held + comma)
                held, comma = text, ","
            if out:
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
        yield pa.RecordBatch.from_pydict({"value": pa.array([held, "]}"], pa.string())})

    dealt = rows.select(*order, F.col(record).alias("record")).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return dealt.select("record").mapInArrow(run, "value string")
