"""Windows under grams that too many places share.

A group of suffixes that share one gram is normally compared in one task. If a
gram is shared by more places than a task should hold (a passage that a third
of the corpus quotes), its suffixes are not grouped by the gram but resolved
window by window: each window is a row keyed by the 128-bit BLAKE2 digest of
its bytes, equal windows of a block of documents are one row with all their
places, and Spark counts or takes minima over the rows of a key, block by
block first. Windows over the edges of the passage differ from document to
document, so they have keys of their own; the windows inside it are few, and
those with many rows are broadcast to their rows (`copies.join_back`). So no
task's input grows with the number of places of one gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytelane.llm.anchors import BLOCK
from bytelane.llm.copies import join_back
from bytelane.llm.store import settle
from bytelane.llm.words import expand, text_blocks

ROWS = "w binary, ids array<long>, keys array<long>, places array<int>"


def window_rows(rows: DataFrame, windows: Callable[[pa.RecordBatch], tuple]) -> DataFrame:
    """`(w, ids, keys, places)`: each distinct window of a block with all its places there.

    `windows(block)` gives `(content, text, place)`: an iterable of the
    windows' bytes, and their text and place in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text", BLOCK):
            content, text, place = windows(block)
            numbers: dict[bytes, int] = {}
            number = np.fromiter((numbers.setdefault(hashlib.blake2b(c, digest_size=16).digest(), len(numbers)) for c in content), np.int64, len(text))
            order = np.argsort(number, kind="stable")
            upto = pa.array(np.searchsorted(number[order], np.arange(len(numbers) + 1)).astype(np.int32))
            take = pa.array(text[order])
            lists = [pa.ListArray.from_arrays(upto, v) for v in (
                block.column("id").take(take), block.column("key").take(take), pa.array(place[order].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.binary()), *lists], names=["w", "ids", "keys", "places"])

    return rows.select("id", "key", "text", "grams").mapInArrow(run, ROWS)


def starts_of(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`(stretch, start)` of all window starts that the stretches own."""
    n = last - first + 1
    return np.repeat(np.arange(len(first)), n), expand(first, n)


def spans(rows: DataFrame, window: int, fact: Column, hit: Callable[[Column], Column], label: str) -> DataFrame:
    """`(id, key, spans)`: the places of each window for which `hit(id)` holds; `fact` is an aggregate over the window's rows, `_fact` in `hit`."""
    rows = settle(rows, label)
    facts = settle(rows.groupBy("w").agg(F.count(F.lit(1)).alias("copies"), fact.alias("_fact")), f"{label}-facts")
    known = join_back(rows, facts, ["w"])
    places = known.select("_fact", F.explode(F.arrays_zip("ids", "keys", "places")).alias("p"))
    span = F.struct(F.col("p.places").alias("start"), (F.col("p.places") + window).alias("end"))
    return places.where(hit(F.col("p.ids"))).groupBy(F.col("p.ids").alias("id"), F.col("p.keys").alias("key")).agg(F.collect_list(span).alias("spans"))
