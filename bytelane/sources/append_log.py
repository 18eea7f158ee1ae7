"""A log that many writers append to, each row exactly once (IO-12).

Layout of a log folder:

    header.csv            the column names, written by the first commit
    data/<commit>/*.csv   rows without a header, one file an attempt of a task
    commits/<commit>.json the files that count

Two phases: every task writes a file of its own under `data`, named by the
attempt, and reports its name; the driver then publishes the files of the
successful attempts by putting one manifest in place, which a rename makes
visible at once. Files of killed or repeated attempts are in no manifest and
are never read. A commit id names an append: one that is there already is not
written again, so a repeated job or micro-batch leaves its rows once. Writers
with different ids never touch each other's files.

The folder is a local or mounted path, or one that `pyarrow.fs` knows.
"""

from __future__ import annotations

import csv
import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import csv as pa_csv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


EMPTY = "\0"  # no text that comes from a log line


class Folder:
    """The few file operations of a log."""

    def __init__(self, path: str):
        if urlparse(path).scheme in ("", "file"):
            self.system, self.root = fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file://").removeprefix("file:"))
        else:
            self.system, self.root = fs.FileSystem.from_uri(path)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.system.get_file_info(self.at(name)).type == fs.FileType.File

    def read(self, name: str) -> bytes:
        with self.system.open_input_stream(self.at(name)) as f:
            return f.read()

    def make(self, folder: str) -> None:
        self.system.create_dir(self.at(folder), recursive=True)

    def output(self, name: str):
        self.make(os.path.dirname(name))
        return self.system.open_output_stream(self.at(name))

    def publish(self, name: str, data: bytes) -> None:
        """The whole file appears at once."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        with self.output(draft) as f:
            f.write(data)
        self.system.move(self.at(draft), self.at(name))

    def names(self, folder: str) -> list[str]:
        found = self.system.get_file_info(fs.FileSelector(self.at(folder), allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.File)

    def remove(self, name: str) -> None:
        if self.exists(name):
            self.system.delete_file(self.at(name))


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


def header_line(columns: list[str]) -> bytes:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(columns)
    return out.getvalue().encode()


class LogWriter(DataSourceArrowWriter):
    def __init__(self, path: str, commit_id: str, columns: list[str]):
        self.path, self.commit_id, self.columns = path, commit_id, columns

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        file, rows = f"data/{self.commit_id}/{uuid.uuid4().hex}.csv", 0
        options = pa_csv.WriteOptions(include_header=False, quoting_style="all_valid")
        with Folder(self.path).output(file) as f:
            for batch in iterator:
                text = batch.cast(pa.schema([(n, pa.string()) for n in batch.schema.names]))
                pa_csv.write_csv(text, f, options)
                rows += batch.num_rows
        return Written(file, rows)

    def commit(self, messages: list[Written | None]) -> None:
        folder = Folder(self.path)
        manifest = f"commits/{self.commit_id}.json"
        if folder.exists(manifest):
            return
        if not folder.exists("header.csv"):
            folder.publish("header.csv", header_line(self.columns))
        check_header(folder, self.columns)
        done = [m for m in messages if m is not None and m.rows]
        folder.publish(manifest, json.dumps({"files": [m.file for m in done], "rows": sum(m.rows for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                Folder(self.path).remove(m.file)


def check_header(folder: Folder, columns: list[str]) -> None:
    if folder.exists("header.csv") and folder.read("header.csv") != header_line(columns):
        raise ValueError(f"the log has other columns: {folder.read('header.csv').decode().strip()}")


class AppendLog(DataSource):
    """Options: `path`, `commit` (the id of this append)."""

    @classmethod
    def name(cls) -> str:
        return "append_log"

    def writer(self, schema: T.StructType, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"], self.options["commit"], schema.names)


def append(df: DataFrame, path: str, commit: str | None = None) -> str:
    """Append the rows of `df`; returns the commit id. An id that is there already is not written again."""
    commit = commit or uuid.uuid4().hex
    folder = Folder(path)
    check_header(folder, df.columns)
    if not folder.exists(f"commits/{commit}.json"):
        df.sparkSession.dataSource.register(AppendLog)
        # Spark renders the values, so that its reader gets the same ones back
        texts = df.select(*[F.col(f.name).cast("string").alias(f.name) for f in df.schema.fields])
        texts.write.format("append_log").mode("append").option("path", path).option("commit", commit).save()
    return commit


def append_stream(path: str, name: str):
    """A `foreachBatch` function that appends each micro-batch under its number."""
    return lambda batch, batch_id: append(batch, path, f"{name}-{batch_id:012d}") and None


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The committed rows with their commit id; columns must be those of the header."""
    folder = Folder(path)
    check_header(folder, schema.names)
    base = path.rstrip("/") if urlparse(path).scheme else folder.root
    files = []
    if any(name.endswith(".json") for name in folder.names("commits")):
        manifests = spark.read.schema("files ARRAY<STRING>").option("pathGlobFilter", "*.json").json(f"{base}/commits")
        files = [r["file"] for r in manifests.select(F.explode("files").alias("file")).collect()]  # the listing that the reader needs anyway
    if not files:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("commit", T.StringType())]))
    paths = [f"{base}/{f}" for f in files]
    # an unquoted empty field is null, a quoted one the empty string: Spark's reader tells them apart by a stand-in
    rows = spark.read.schema(schema).options(mode="FAILFAST", multiLine=True, escape='"', nullValue="", emptyValue=EMPTY).csv(paths)
    values = [F.when(F.col(f.name) == EMPTY, "").otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema.fields]
    return rows.select(*values, F.element_at(F.split("_metadata.file_path", "/"), -2).alias("commit"))
