from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from bytelane.sources import append_log as A
from bytelane.sources.logs import LOSS_LOG

SCHEMA = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("text", T.StringType()), T.StructField("x", T.DoubleType()),
     T.StructField("at", T.TimestampType()), T.StructField("ok", T.BooleanType())])


def rows(lo, hi):
    hard = ["plain", "", None, 'quo"te', "a,b", "two\nlines", "é\\n", " blank "]
    return [(i, hard[i % 8], i / 7 if i % 5 else None, datetime(2024, 1, 1, 0, 0, i % 60, i), None if i % 3 == 0 else i % 3 == 1) for i in range(lo, hi)]


def frame(spark, lo, hi, parts=3):
    return spark.createDataFrame(rows(lo, hi), SCHEMA).repartition(parts)


def content(spark, path):
    return sorted((tuple(r)[:-1] for r in A.read(spark, path, SCHEMA).collect()), key=lambda r: r[0])


def test_appended_rows_come_back(spark, tmp_path):
    path = str(tmp_path / "log")
    assert content(spark, path) == []
    A.append(frame(spark, 0, 40), path)
    A.append(frame(spark, 40, 41), path)
    A.append(frame(spark, 0, 0), path)
    assert content(spark, path) == rows(0, 41)
    assert (tmp_path / "log" / "header.csv").read_text() == "n,text,x,at,ok\n"


def test_a_repeated_commit_leaves_its_rows_once(spark, tmp_path):
    path = str(tmp_path)
    for _ in range(3):
        assert A.append(frame(spark, 0, 10), path, "first") == "first"
    A.LogWriter(path, "first", SCHEMA.names).commit([A.Written("data/first/none.csv", 5)])
    assert content(spark, path) == rows(0, 10)


def test_killed_and_repeated_attempts_are_not_read(spark, tmp_path):
    path = str(tmp_path)
    writer = A.LogWriter(path, "c", ["n"])

    def batches(n, fail=False):
        yield pa.RecordBatch.from_pydict({"n": [str(i) for i in range(n)]})
        if fail:
            raise OSError("the executor is lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(batches(5, fail=True))
    twice = [writer.write(batches(5)) for _ in range(2)]  # a speculative copy
    writer.commit([twice[1], None])
    schema = T._parse_datatype_string("n long")
    assert sorted(r.n for r in A.read(spark, path, schema).collect()) == list(range(5))
    assert len(list((tmp_path / "data" / "c").glob("*.csv"))) == 3
    left = writer.write(batches(2))
    writer.abort([left, None])
    assert not (tmp_path / left.file).exists()


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    df = frame(spark, 0, 20).selectExpr("n", "text", "x", "at", "assert_true(n < 15) is null as ok")
    with pytest.raises(Exception):  # noqa: B017
        A.append(df, str(tmp_path))
    assert content(spark, str(tmp_path)) == []


def test_concurrent_writers(spark, tmp_path):
    path = str(tmp_path)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: A.append(frame(spark, i * 10, i * 10 + 10), path), range(6)))
    assert content(spark, path) == rows(0, 60)
    assert len(list((tmp_path / "commits").iterdir())) == 6


def test_other_columns_are_refused(spark, tmp_path):
    A.append(frame(spark, 0, 2), str(tmp_path))
    with pytest.raises(ValueError, match="other columns"):
        A.append(spark.range(3), str(tmp_path))
    with pytest.raises(ValueError, match="other columns"):
        A.read(spark, str(tmp_path), LOSS_LOG)


def test_a_stream_appends_each_batch_once(spark, tmp_path):
    path, src = str(tmp_path / "log"), str(tmp_path / "src")
    frame(spark, 0, 30, 3).write.parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    for checkpoint in ("one", "two"):  # the second run starts over, under the same batch numbers
        q = stream.writeStream.foreachBatch(A.append_stream(path, "s")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert content(spark, path) == rows(0, 30)
