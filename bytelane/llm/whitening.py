"""Embedding whitening from a weighted covariance of the distinct vectors.

1. Every entry c becomes the integer x = floor(64 c) + 1000000. Vectors are
   packed into the shortest integers that hold them (one canonical byte
   string a vector) and grouped: `distinct` has each x vector once, with the
   number of its copies.
2. Sums: n and the sum of each dimension, as exact integers, with weight one
   for each distinct vector or with its copies as weight.
3. Covariance: one weighted, centred matrix product a task, whose rows are
   added by Spark. The driver gets one d x d matrix.
4. The eigenvectors turn each distinct vector once; the result is a table.
   Its covariance is measured in the same way and compared with the identity.
5. Rows get the result of their vector by a join on the packed vector; the
   few vectors with many copies are broadcast (`copies.join_back`).

Defined results: rows whose vector is null or holds null or non-finite entries
are dropped; vectors of another length have a fit of their own (n, sums,
components), vectors without entries have no components and give no rows; a
component without variance (at double precision) has null as whitened value
and takes no part in the identity error; `explained` is null if there is no
variance at all; entries beyond 2**46 count as 2**46; a deviation beyond 64
bits is null; null and repeated ids are kept row by row; an empty table gives
no rows; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelane.llm.copies import join_back
from bytelane.llm.store import settle

SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 52  # of an x before the shift
MAX_COMPONENTS = 16
BLOCK_ROWS = 4096
_LONG = (1 << 63) - 1


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """`(values, offsets)` of a list column without null lists; null entries are NaN."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), offsets - offsets[0]


def _packed(x: np.ndarray, width: int) -> pa.Array:
    """Rows of integers as byte strings: the width, then the integers."""
    n, d = x.shape
    raw = np.empty((n, 1 + d * width), np.uint8)
    raw[:, 0] = width
    raw[:, 1:] = np.ascontiguousarray(x.astype(f"<i{width}")).view(np.uint8).reshape(n, d * width)
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(1 + d * width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _unpacked(keys: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`(rows, x)` by vector length, x without the shift."""
    offsets = np.frombuffer(keys.buffers()[1], np.int32, len(keys) + 1, keys.offset * 4).astype(np.int64)
    raw = np.frombuffer(keys.buffers()[2], np.uint8)
    sizes, widths = np.diff(offsets), raw[offsets[:-1]].astype(np.int64)
    shape = np.stack([(sizes - 1) // widths, widths], axis=1)
    by_length: dict[int, list] = {}
    for d, width in np.unique(shape, axis=0).tolist():
        at = np.flatnonzero((shape == (d, width)).all(axis=1))
        body = raw[(offsets[at] + 1)[:, None] + np.arange(d * width)]
        by_length.setdefault(d, []).append((at, np.ascontiguousarray(body).view(f"<i{width}").reshape(len(at), d).astype(np.int64)))
    for parts in by_length.values():
        yield np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`(id, x)`: the packed x vector of every row whose vector is whole and finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c, offsets = _lists(batch.column("v"))
            sizes = np.diff(offsets)
            bad = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(c)], minlength=len(sizes)) > 0
            x = np.clip(np.floor(SCALE * np.where(np.isfinite(c), c, 0)), -LARGEST, LARGEST).astype(np.int64)
            for d in np.unique(sizes[~bad]).tolist():
                rows = np.flatnonzero((sizes == d) & ~bad)
                part = x[offsets[rows][:, None] + np.arange(d)]
                peak = np.abs(part).max(axis=1, initial=0)
                width = np.where(peak < 1 << 15, 2, np.where(peak < 1 << 31, 4, 8))
                for w in np.unique(width).tolist():
                    own = width == w
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(rows[own])), _packed(part[own], w)], names=["id", "x"])

    v = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return v.mapInArrow(run, "id long, x binary")


@dataclass
class Fit:
    """What is known of the vectors of one length."""

    n: int
    sums: list[int]  # of x without the shift
    values: np.ndarray  # eigenvalues of the components, falling
    turn: np.ndarray  # d x k, by the root of the eigenvalue; zero columns where there is no variance
    used: np.ndarray
    total: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _sums(distinct: DataFrame, weight: str) -> dict[int, tuple[int, list[int]]]:
    """`{length: (n, exact sums)}`; one row a length and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for batch in batches:
            w_all = batch.column("w").to_numpy()
            for rows, x in _unpacked(batch.column("x")):
                w = w_all[rows]
                x = np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1)
                if float(np.abs(x).max()) * float(w.sum()) >= float(1 << 62):
                    w, x = w.astype(object), x.astype(object)
                got = [int(s) for s in w @ x]
                held[x.shape[1] - 1] = [a + b for a, b in zip(held.get(x.shape[1] - 1, [0] * len(got)), got, strict=True)]
        rows = [(d, i - 1, s) for d, sums in held.items() for i, s in enumerate(sums)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.decimal128(38, 0))],
            names=["d", "i", "s"])

    w = F.col("copies") if weight == "copies" else F.lit(1)
    parts = distinct.select("x", w.cast("long").alias("w")).mapInArrow(run, "d int, i int, s decimal(38,0)")
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("d", "i").agg(F.sum("s").alias("s")).collect():  # one row a dimension
        found.setdefault(r["d"], {})[r["i"]] = int(r["s"])
    return {d: (by[-1], [by[i] for i in range(d)]) for d, by in found.items() if d}


def _covariance(rows: DataFrame, decode: Callable, centres: dict[int, np.ndarray], n: dict[int, int]) -> dict[int, np.ndarray]:
    """`{length: covariance}` of what `decode(batch)` gives as `(length, matrix, weights)`, centred before multiplying."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                for d, y, w in decode(batch.slice(at, BLOCK_ROWS)):
                    if d in centres:
                        y = y - centres[d]
                        held[d] = held.get(d, 0) + (y * w[:, None]).T @ y
        for d, g in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * len(g), pa.int32()), pa.array(range(len(g)), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))],
                names=["d", "i", "row"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(len(group.column("row")[0]))
        for chunk in group.column("row").chunks:
            total += chunk.flatten().to_numpy().reshape(len(chunk), -1).sum(axis=0)
        return pa.table({"d": group.column("d").slice(0, 1), "i": group.column("i").slice(0, 1), "row": pa.array([total], pa.list_(pa.float64()))})

    kind = "d int, i int, row array<double>"
    found: dict[int, dict[int, list[float]]] = {}
    for r in rows.mapInArrow(run, kind).groupBy("d", "i").applyInArrow(add, kind).collect():  # one row a dimension
        found.setdefault(r["d"], {})[r["i"]] = r["row"]
    return {d: np.array([by[i] for i in sorted(by)]) / n[d] for d, by in found.items()}


def _weights(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("w").to_numpy().astype(np.float64)


def _decode_x(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    w = _weights(batch)
    for rows, x in _unpacked(batch.column("x")):
        yield x.shape[1], x.astype(np.float64), w[rows]


def _decode_whitened(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    w, d = _weights(batch), batch.column("d").to_numpy()
    values, offsets = _lists(batch.column("whitened"))
    for length in np.unique(d).tolist():
        rows = np.flatnonzero(d == length)
        k = int(offsets[rows[0] + 1] - offsets[rows[0]])
        yield length, np.nan_to_num(values[offsets[rows][:, None] + np.arange(k)]), w[rows]


def fit(distinct: DataFrame, components: int = MAX_COMPONENTS, weight: str = "distinct") -> dict[int, Fit]:
    """Components of the `distinct (x, copies)` vectors, for each length; `weight` is "distinct" (one) or "copies"."""
    if weight not in ("distinct", "copies"):
        raise ValueError(f"weight is 'distinct' or 'copies', not {weight!r}")
    sums = _sums(distinct, weight)
    n = {d: s[0] for d, s in sums.items()}
    w = F.col("copies") if weight == "copies" else F.lit(1)
    covariance = _covariance(
        distinct.select("x", w.cast("long").alias("w")), _decode_x, {d: np.array([v / s[0] for v in s[1]]) for d, s in sums.items()}, n)
    out = {}
    for d, v in covariance.items():
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        used = values > max(values[0], 0) * d * np.finfo(float).eps
        out[d] = Fit(*sums[d], values, np.where(used, vectors / np.sqrt(np.where(used, values, 1)), 0), used, float(np.trace(v)))
    return out


def _deviation(x: np.ndarray, f: Fit) -> list[int | None]:
    """Sum over the dimensions of (n x - sums)**2, exactly."""
    sums = np.array(f.sums, object)
    if max(abs(s) for s in f.sums) < 1 << 62 and f.n * float(np.abs(x).max()) < float(1 << 62):
        y = x * f.n - sums.astype(np.int64)
        if float(np.abs(y).max()) ** 2 * x.shape[1] < float(1 << 62):
            return (y * y).sum(axis=1).tolist()
    y = x.astype(object) * f.n - sums
    return [s if s <= _LONG else None for s in (y * y).sum(axis=1).tolist()]


def transform(distinct: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """`(x, copies, d, deviation, whitened)`: each distinct vector turned once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(at, BLOCK_ROWS)
                for rows, x in _unpacked(block.column("x")):
                    if x.shape[1] not in fits:
                        continue
                    f, take = fits[x.shape[1]], pa.array(rows)
                    y = (x - f.mean) @ f.turn
                    k = y.shape[1]
                    values = pa.array(y.ravel(), mask=np.tile(~f.used, len(y)))
                    whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * np.int32(k)), values)
                    yield pa.RecordBatch.from_arrays(
                        [block.column("x").take(take), block.column("copies").take(take), pa.array(np.full(len(x), x.shape[1], np.int32)),
                         pa.array(_deviation(x, f), pa.int64()), whitened], names=["x", "copies", "d", "deviation", "whitened"])

    return distinct.select("x", "copies").mapInArrow(run, "x binary, copies long, d int, deviation long, whitened array<double>")


def identity_errors(turned: DataFrame, fits: dict[int, Fit], weight: str = "distinct") -> dict[int, float]:
    """Largest entry of the whitened vectors' covariance minus the identity, by length."""
    w = F.col("copies") if weight == "copies" else F.lit(1)
    t = turned.select("d", "whitened", w.cast("long").alias("w"))
    centres = {d: np.zeros(len(f.values)) for d, f in fits.items()}
    means = t.select("d", "w", F.posexplode("whitened").alias("i", "y")).groupBy("d", "i").agg(F.sum(F.col("y") * F.col("w")).alias("s"))
    for r in means.collect():  # one row a component
        centres[r["d"]][r["i"]] = (r["s"] or 0.0) / fits[r["d"]].n
    found = _covariance(t, _decode_whitened, centres, {d: f.n for d, f in fits.items()})
    return {d: float(np.abs(c - np.eye(len(c)))[np.ix_(fits[d].used, fits[d].used)].max(initial=0)) for d, c in found.items()}


def whiten(vectors: DataFrame, components: int = MAX_COMPONENTS, weight: str = "distinct", id_col: str = "vec_id",
           vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """`(id, x, copies, d, deviation, whitened)` for every usable row, and the table of components.

    The components: `(d, component, n, explained, identity_error)`, a few rows
    for each vector length.
    """
    spark = vectors.sparkSession
    rows = settle(quantised(vectors, id_col, vector_col), "vectors")
    distinct = settle(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")), "distinct")
    fits = fit(distinct, components, weight)
    turned = settle(transform(distinct, fits), "whitened")
    errors = identity_errors(turned, fits, weight)
    known = [
        (d, i + 1, f.n, float(f.values[i] / f.total) if f.total > 0 else None, errors.get(d, 0.0))
        for d, f in fits.items() for i in range(len(f.values))]
    table = spark.createDataFrame(known, "d int, component int, n long, explained double, identity_error double")
    return join_back(rows, turned, ["x"]), table


def component_rows(whitened: DataFrame, components: DataFrame, id_name: str = "vec_id") -> DataFrame:
    """One row for each vector and component."""
    long_ = whitened.select(F.col("id").alias(id_name), "d", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    long_ = long_.withColumn("component", F.col("i") + 1).drop("i")
    return long_.join(F.broadcast(components), ["d", "component"]).select(
        id_name, "component", "n", "deviation", "whitened", "explained", "identity_error")
