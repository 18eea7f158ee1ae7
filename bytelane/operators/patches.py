"""Sequence reshaping for hierarchical models (W-18 .. W-20).

Per-row array expressions, and one Arrow function for whole byte windows: a
sample never leaves its row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelane.functions.arrays import chunk

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shift_right(tokens: ColumnOrName, start_token: int) -> Column:
    """W-18 on arrays: inputs aligned with targets = [start] + tokens[:-1]."""
    t = _c(tokens)
    return F.when(F.size(t) == 0, t).otherwise(
        F.concat(F.array(F.lit(start_token).cast("bigint")), F.slice(t.cast("array<bigint>"), 1, F.size(t) - 1))
    )


def shift_right_rows(df: DataFrame, group: list[str], pos: str, token: str, start_token: int, out: str = "input") -> DataFrame:
    """W-18 on tall rows (one token per row): the previous token of the same sequence."""
    w = Window.partitionBy(*group).orderBy(pos)
    return df.withColumn(out, F.coalesce(F.lag(token).over(w), F.lit(start_token)))


def to_patches(tokens: ColumnOrName, seq_lens: Sequence[int], pad: int, *, fixed_outer: bool = True) -> Column:
    """W-19: right-pad to a multiple of prod(seq_lens[1:]) and nest as (P1', P2, ..., Pn).

    With fixed positions the outer length P1' may not exceed P1.
    """
    if len(seq_lens) < 2:
        raise ValueError("need at least two stages")
    t = _c(tokens).cast("array<bigint>")
    inner = math.prod(seq_lens[1:])
    n = F.size(t)
    padded_len = F.ceil(n / F.lit(inner)).cast("int") * F.lit(inner)
    padded = F.concat(t, F.array_repeat(F.lit(pad).cast("bigint"), padded_len - n))
    if fixed_outer:
        padded = F.when(
            F.assert_true(padded_len / F.lit(inner) <= F.lit(seq_lens[0]), "sequence longer than the first stage").isNull(),
            padded,
        )
    nested = padded
    # nest from the innermost stage outwards; `chunk` binds its input once
    for size in reversed(seq_lens[1:]):
        nested = chunk(nested, size)
    return nested


def patch_windows(windows: DataFrame, seq_lens: Sequence[int], pad: int, *, tokens: str = "tokens", out: str = "patches") -> DataFrame:
    """W-19 on byte windows: `windows` with the nested array `out`, built over Arrow batches.

    The same result as `to_patches(bytes_to_array(tokens), ...)` with fixed
    positions: the bytes of a batch are laid out once and nested by offsets,
    instead of one interpreted slice per patch.
    """
    if len(seq_lens) < 2:
        raise ValueError("need at least two stages")
    inner = math.prod(seq_lens[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x or b"" for x in batch.column(tokens).to_pylist()]
            n = np.array([len(x) for x in rows], np.int64)
            outer = -(-n // inner)
            if len(n) and outer.max() > seq_lens[0]:
                raise ValueError(f"a sequence needs {int(outer.max())} patches, the first stage has {seq_lens[0]}")
            start = np.cumsum(outer * inner) - outer * inner
            values = np.full(int((outer * inner).sum()), pad, np.int64)
            values[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = np.frombuffer(b"".join(rows), np.uint8)
            nested: pa.Array = pa.array(values)
            for size in reversed(seq_lens[1:]):
                nested = pa.ListArray.from_arrays(pa.array(np.arange(0, len(nested) + 1, size, dtype=np.int32)), nested)
            nested = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(outer)]).astype(np.int32)), nested)
            yield pa.RecordBatch.from_arrays([*batch.columns, nested], names=[*batch.schema.names, out])

    kind = T.LongType()
    for _ in seq_lens:
        kind = T.ArrayType(kind)
    return windows.mapInArrow(run, T.StructType([*windows.schema.fields, T.StructField(out, kind)]))


def from_patches(patches: ColumnOrName, depth: int, length: ColumnOrName) -> Column:
    """W-20: flatten `depth` levels and drop the padding beyond `length`."""
    x = _c(patches)
    for _ in range(depth):
        x = F.flatten(x)
    return F.slice(x, 1, _c(length))
