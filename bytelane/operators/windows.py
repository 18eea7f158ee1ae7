"""Byte corpus -> fixed-length training windows (W-1 .. W-8, F-14 .. F-16).

The corpus is the concatenation of all documents in key order; it is never
materialised. Each document knows its global byte offset (W-1, computed on
metadata only), and is cut into the pieces it contributes to each window:

* a piece that is a whole window (the usual case when documents are longer
  than L) is emitted where the document was read: no shuffle;
* pieces of windows that span document boundaries are grouped by window and
  concatenated in offset order. A group holds at most L bytes, so no group can
  grow with the data, whatever the document size distribution.

Sharding follows a fixed rule: shard size S = total // workers, worker w owns
[w*S, (w+1)*S); the remainder of the corpus is dropped; inside a shard window
j starts at w*S + offset + j*L and the tail (S - offset) % L is dropped unless
`include_tail` asks for the one short window after the last full one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelane.functions.bytes import bytes_to_array
from bytelane.functions.hashing import uniform_int
from bytelane.operators.offsets import Totals, global_row_index, join_small_or_shuffle, prefix_sum


SMALL_PER_CORE = 32 << 20  # bytes of text
MASK_POSITIONS = 1 << 20  # of the windows that are masked at a time


@dataclass(frozen=True)
class ShardSpec:
    """Arithmetic of one sharding: all values are plain driver-side integers."""

    total: int  # corpus size in elements
    workers: int
    shard: int  # elements per worker (remainder dropped)
    seq_len: int
    offset: int  # already reduced modulo seq_len
    count: int  # windows per worker (W-6)
    include_tail: bool = False

    @property
    def span(self) -> int:
        """Elements per worker covered by windows (incl. the tail window)."""
        return self.count * self.seq_len + (self.seq_len if self.include_tail else 0)


def shard_spec(
    total: int, seq_len: int, workers: int = 1, offset: int = 0, include_tail: bool = False, sequential: bool = True
) -> ShardSpec:
    """W-2 / W-5 / W-6 with the reference's argument checks."""
    if workers <= 0:
        raise ValueError("at least one worker is needed")
    if seq_len <= 0:
        raise ValueError("a window needs at least one element")
    shard = total // workers
    if sequential and shard < seq_len:
        raise ValueError("a worker's share is smaller than one window")
    if not sequential and shard < 1:
        raise ValueError("a worker's share is smaller than one window")
    if not sequential:
        return ShardSpec(total, workers, shard, seq_len, 0, shard, False)
    off = offset % seq_len
    return ShardSpec(total, workers, shard, seq_len, off, max((shard - off) // seq_len, 0), include_tail)


def _fdiv(a: Column, b: int) -> Column:
    """Exact floor division of BIGINT by a positive constant."""
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("bigint")


def corpus_offsets(docs: DataFrame, key: str = "doc_id", content: str = "content") -> tuple[DataFrame, Totals]:
    """W-1: `(key, n_bytes, start)` with start = bytes of all earlier documents."""
    length = F.col("n_bytes") if "n_bytes" in docs.columns else F.octet_length(content)
    offs, tot = prefix_sum(docs, key, length, "start", unique=True)
    return offs.withColumnRenamed("_value", "n_bytes"), tot


def locate_documents(docs: DataFrame, key: str = "doc_id", content: str = "content") -> tuple[DataFrame, Totals]:
    """Documents with their global start offset: `(key, content, n_bytes, start)`."""
    offs, tot = corpus_offsets(docs, key, content)
    contents = docs.select(key, content)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if tot.total < cores * SMALL_PER_CORE:
        # a corpus of one file part would be cut by one task; only so few
        # bytes are ever moved for it, larger corpora stay where they are read
        contents = contents.repartition(cores, key)
    located = join_small_or_shuffle(contents, offs, key, tot.rows)
    return located, tot


def window_pieces(located: DataFrame, spec: ShardSpec, *, key: str = "doc_id", content: str = "content", worker: int | None = None) -> DataFrame:
    """Explode each document into the (worker, window) pieces it contributes."""
    S, L, off, G, T = spec.shard, spec.seq_len, spec.offset, spec.span, spec.total
    s = F.col("start")
    e = s + F.col("n_bytes")
    w_lo = F.greatest(_fdiv(s - F.lit(off + G), S) + 1, F.lit(0))
    w_hi = F.least(_fdiv(e - F.lit(1 + off), S), F.lit(spec.workers - 1))
    if worker is not None:
        if not 0 <= worker < spec.workers:
            raise ValueError(f"worker {worker} is not among the {spec.workers} workers")
        w_lo = F.greatest(w_lo, F.lit(worker))
        w_hi = F.least(w_hi, F.lit(worker))
    per_worker = located.select(
        key, content, "start", "n_bytes",
        F.explode(F.when(w_lo <= w_hi, F.sequence(w_lo, w_hi)).otherwise(F.array().cast("array<bigint>"))).alias("worker"),
    )
    r0 = F.col("worker") * F.lit(S) + F.lit(off)
    a = F.greatest(s, r0)
    b = F.least(e, r0 + F.lit(G), F.lit(T))
    per_worker = per_worker.withColumn("_a", a).withColumn("_bb", b).withColumn("_r0", r0)
    j_lo = _fdiv(F.col("_a") - F.col("_r0"), L)
    j_hi = _fdiv(F.col("_bb") - F.col("_r0") - 1, L)
    pieces = per_worker.select(
        "*",
        F.explode(
            F.when(F.col("_a") < F.col("_bb"), F.sequence(j_lo, j_hi)).otherwise(F.array().cast("array<bigint>"))
        ).alias("idx"),
    )
    ws = F.col("_r0") + F.col("idx") * F.lit(L)
    we = F.least(ws + F.lit(L), F.lit(T))
    p0 = F.greatest(F.col("_a"), ws)
    p1 = F.least(F.col("_bb"), we)
    return pieces.select(
        F.col("worker").cast("int").alias("worker"),
        "idx",
        ws.alias("win_start"),
        (we - ws).alias("win_len"),
        p0.alias("p0"),
        (p1 - p0).alias("piece_len"),
        F.substring(F.col(content), (p0 - s + 1).cast("int"), (p1 - p0).cast("int")).alias("piece"),
    )


def assemble_windows(pieces: DataFrame) -> DataFrame:
    """Whole-window pieces pass through; the rest are concatenated per window.

    The branches are told apart by lengths alone, so a piece is cut out of its
    document only in the branch that keeps it.
    """
    whole = pieces.where(F.col("piece_len") == F.col("win_len")).select(
        "worker", "idx", F.col("win_start").alias("start"), F.col("piece").alias("tokens")
    )
    # ISO-8859-1 maps bytes 1:1 to characters, so array_join concatenates the
    # ordered pieces in linear time and encode() turns them back into bytes.
    parts = (
        pieces.where(F.col("piece_len") != F.col("win_len"))
        .groupBy("worker", "idx", "win_start")
        .agg(F.sort_array(F.collect_list(F.struct("p0", F.decode("piece", "ISO-8859-1").alias("s")))).alias("ps"))
    )
    joined = parts.select(
        "worker",
        "idx",
        F.col("win_start").alias("start"),
        F.encode(F.array_join(F.transform("ps", lambda x: x["s"]), ""), "ISO-8859-1").alias("tokens"),
    )
    out = whole.unionByName(joined)
    return out.withColumn("n_bytes", F.octet_length("tokens"))


def byte_windows(
    docs: DataFrame,
    seq_len: int,
    *,
    workers: int = 1,
    worker: int | None = None,
    offset: int = 0,
    include_tail: bool = False,
    key: str = "doc_id",
    content: str = "content",
) -> tuple[DataFrame, ShardSpec]:
    """W-2 + W-3 (+ W-5 offset): `(worker, idx, start, tokens BINARY, n_bytes)`.

    `idx` is the window index inside the worker's shard; `start` its global
    byte offset. Pass `worker` to build one worker's windows only.
    """
    located, tot = locate_documents(docs, key, content)
    spec = shard_spec(tot.total, seq_len, workers, offset, include_tail)
    return assemble_windows(window_pieces(located, spec, key=key, content=content, worker=worker)), spec


def with_loss_mask(windows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """F-14 + sample shape: `(tokens ARRAY<INT>, loss_mask ARRAY<FLOAT> of ones)`."""
    arr = bytes_to_array(tokens)
    return windows.withColumn("token_ids", arr).withColumn(
        "loss_mask", F.array_repeat(F.lit(1.0).cast("float"), F.size("token_ids"))
    )


def masked_sample(
    windows: DataFrame,
    seq_len: int,
    *,
    mask_token_id: int = -100,
    pad_token_id: int = -101,
    masking_proba: float = 0.15,
    seed: int = 0,
    epoch: int = 0,
    hash_mode: str = "xxhash64",
    tokens: str = "tokens",
) -> DataFrame:
    """F-15 / F-16 / W-8: masked ids, mask, labels; short windows padded to L.

    Position i of window (worker, idx) is masked when its hash unit of
    (seed, epoch, worker, idx, i) is below p, so the mask changes with the
    epoch and survives task retries. Padding is never masked. In md5 mode one
    digest of (seed, epoch, worker, idx, i div 4) gives the units of four
    positions; "xxhash64" stands for the fast mode, a vectorised counter hash.
    Both run over Arrow batches of windows, `MASK_POSITIONS` positions at a
    time, as a position takes some 40 bytes meanwhile.
    """
    if mask_token_id == pad_token_id:
        raise ValueError("mask and padding need two different ids")
    if hash_mode not in ("xxhash64", "md5"):
        raise ValueError(f"unknown hash mode {hash_mode!r}")
    kept = [c for c in windows.columns if c != tokens]
    limit = min(max(math.ceil(masking_proba * 2**32), 0), 2**32)
    rows = max(MASK_POSITIONS // max(seq_len, 1), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, rows) for whole in batches for at in range(0, whole.num_rows, rows)):
            workers, idx = batch.column("worker").to_pylist(), batch.column("idx").to_pylist()
            data = batch.column(tokens)
            pieces = [x or b"" for x in data.to_pylist()]
            n = np.array([len(x) for x in pieces], np.int64)
            raw = np.frombuffer(b"".join(pieces), np.uint8)
            units = [mask_units(k, seed, epoch, w, j, hash_mode) for k, w, j in zip(n.tolist(), workers, idx)]
            hit = (np.concatenate(units) if units else np.zeros(0, np.uint32)) < limit
            # every window becomes a row of max(n, seq_len) elements
            size = np.maximum(n, seq_len)
            bounds = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(bounds[:-1] - (np.cumsum(n) - n), n) + np.arange(len(raw))
            labels = np.full(int(bounds[-1]), pad_token_id, np.int32)
            mask = np.zeros(len(labels), bool)
            labels[at], mask[at] = raw, hit
            masked = np.where(mask, np.int32(mask_token_id), labels)
            offsets = pa.array(bounds.astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (masked, mask, labels)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *lists], names=[*kept, "masked_ids", "mask", "labels"])

    schema = T.StructType([
        *[windows.schema[c] for c in kept],
        T.StructField("masked_ids", T.ArrayType(T.IntegerType())),
        T.StructField("mask", T.ArrayType(T.BooleanType())),
        T.StructField("labels", T.ArrayType(T.IntegerType())),
    ])
    return windows.mapInArrow(run, schema)


def mask_units(n: int, seed: int, epoch: int, worker: int, idx: int, hash_mode: str) -> np.ndarray:
    """32-bit units of the n positions of one window, from stable keys only."""
    if hash_mode == "md5":
        prefix = f"{seed}|{epoch}|{worker}|{idx}|".encode()
        digests = b"".join([hashlib.md5(prefix + str(g).encode()).digest() for g in range(-(-n // 4))])
        return np.frombuffer(digests, ">u4")[:n]
    # a counter hash: the window's key, then one step per position
    with np.errstate(over="ignore"):
        key = np.uint64(0x9E3779B97F4A7C15)
        for part in (seed, epoch, worker, idx):
            key = (key ^ np.uint64(part & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
        x = key + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


def mlm_targets(labels: Column | str, mask: Column | str, mask_token_id: int) -> Column:
    """F-16: label where masked, else the mask id (which the loss ignores)."""
    lab = F.col(labels) if isinstance(labels, str) else labels
    msk = F.col(mask) if isinstance(mask, str) else mask
    checked = F.when(
        F.assert_true(F.size(lab) == F.size(msk), "labels and mask differ in size").isNull(), lab
    )
    return F.zip_with(checked, msk, lambda l, m: F.when(m, l).otherwise(F.lit(mask_token_id)))


def random_windows(
    docs: DataFrame,
    seq_len: int,
    k: int,
    *,
    seed: int = 0,
    hash_mode: str = "xxhash64",
    key: str = "doc_id",
    content: str = "content",
    max_broadcast_draws: int = 1_000_000,
) -> DataFrame:
    """W-7: k windows with start uniform in [0, total - L - 1] (the last legal start excluded).

    A random window overlaps at most two aligned windows (idx = start div L and
    the next), so it is cut from an equi-join of the starts with the aligned
    windows; no cross join, each start meets at most two rows. When the draws
    are few (2k ids below `max_broadcast_draws`), only the aligned windows they
    touch are assembled: the pieces are semi-joined with the broadcast id set
    before any shuffle.
    """
    located, tot = locate_documents(docs, key, content)
    L = seq_len
    if tot.total - L - 1 < 0:
        raise ValueError("corpus shorter than one window")
    spec = shard_spec(tot.total, L, 1, 0, include_tail=True)
    spark = docs.sparkSession
    starts = spark.range(k).select(
        F.col("id").alias("draw"),
        uniform_int(F.lit(seed), F.col("id"), upper=tot.total - L, mode=hash_mode).alias("start"),
    ).withColumn("a", _fdiv(F.col("start"), L))
    pieces = window_pieces(located, spec, key=key, content=content)
    if 2 * k <= max_broadcast_draws:
        needed = starts.select(F.col("a").alias("idx")).union(starts.select((F.col("a") + 1).alias("idx"))).distinct()
        pieces = pieces.join(F.broadcast(needed), "idx", "left_semi")
    aligned = assemble_windows(pieces).select("idx", "tokens")
    first = aligned.select(F.col("idx").alias("a"), F.col("tokens").alias("t0"))
    second = aligned.select((F.col("idx") - 1).alias("a"), F.col("tokens").alias("t1"))
    j = starts.join(first, "a", "left").join(second, "a", "left")
    both = F.concat(F.coalesce("t0", F.lit(b"")), F.coalesce("t1", F.lit(b"")))
    rel = (F.col("start") - F.col("a") * F.lit(L) + 1).cast("int")
    return j.select("draw", "start", F.substring(both, rel, L).alias("tokens"))


def row_shards(
    df: DataFrame, key: str, *, workers: int, worker: int | None = None, keep: list[str] | None = None
) -> DataFrame:
    """W-4: item-mode sharding by global row position in `key` order.

    n = rows // workers; row i goes to worker i div n at item i mod n; the last
    rows % workers rows are dropped. Offsets have no effect in item mode.
    """
    idx, tot = global_row_index(df, key, "row_idx", keep=keep)
    spec = shard_spec(tot.rows, 1, workers, sequential=False)
    n = spec.shard
    out = idx.where(F.col("row_idx") < F.lit(workers * n)).select(
        *[c for c in idx.columns if c != "row_idx"],
        "row_idx",
        _fdiv(F.col("row_idx"), n).cast("int").alias("worker"),
        F.pmod(F.col("row_idx"), F.lit(n)).alias("item"),
    )
    if worker is not None:
        out = out.where(F.col("worker") == worker)
    return out
