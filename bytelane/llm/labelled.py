"""Bounded samples of labelled rows for fitting, and columns from per-block scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelane.llm.store import settle
from bytelane.llm.words import text_blocks


def held_out(id_col: Column) -> Column:
    """True for the fifth of the ids that is never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def sample_of(labels: DataFrame, label: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most `rows` labelled ids `(_id, _label)` outside the held-out fifth, by hash order.

    A repeated id counts once, with its largest label; null ids and labels are left out.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    one = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    return one.orderBy(F.xxhash64("_id"), "_id").limit(rows)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str, text_col: str) -> DataFrame:
    """`(label, text, h)` of the sampled documents, written once: one row an id, so at most `rows`; h orders them.

    Of rows that share an id the one with the least text counts; the sample is
    bounded, so it is broadcast.
    """
    sample = F.broadcast(sample_of(labels, label, rows, id_col))
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(sample, "_id")
    one = found.groupBy("_id").agg(F.max("_label").alias("label"), F.min("text").alias("text"))
    return settle(one.select("label", "text", F.xxhash64("_id").alias("h")), "labelled")


def within(rows: DataFrame, size: Column, limit: int) -> DataFrame:
    """The first rows in the order of `h` whose sizes sum up to `limit` at most; larger rows are left out.

    `rows` is a sample, so its hashes and sizes fit on the driver.
    """
    sizes = sorted((r["h"], r["n"]) for r in rows.select("h", size.cast("long").alias("n")).collect())
    total, last = 0, None
    for h, n in sizes:
        if n <= limit:
            total += n
            if total > limit:
                # rows that share the hash of the first one too many stay out with it
                return rows.where((size <= limit) & (F.col("h") < h))
            last = h
    return rows.where((size <= limit) & (F.col("h") <= last)) if last is not None else rows.where("false")


def with_block_scores(docs: DataFrame, text_col: str, out: str, score: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """`docs` and a column `out`, computed from blocks of whole texts; all other columns pass through."""
    if out in docs.columns:
        raise ValueError(f"the table has a column {out!r} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text_col):
            scores = pa.array(score(block.column(text_col)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*block.columns, scores], names=[*block.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
