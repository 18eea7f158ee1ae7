"""SimHash near-duplicates by Golay-code fuzzy hashing.

1. Fingerprints: per document, over the XXH64 values of its word shingles, a
   bit is set if it is set in more than half of them (in Arrow batches).
2. Equal fingerprints are merged first; everything below works on distinct
   ones, so groups of exact copies of any size cost nothing.
3. A fingerprint has three segments of 22, 21 and 21 bits. With at most two
   differing bits one segment is equal and the next one differs in at most
   two, so both fingerprints share a Golay index of it. Keys: an equal
   segment with each nearby index of the segment after it (cyclic).
4. Fingerprints with a common key are compared. A key with more than
   `BUCKET` of them goes another exact way: each member is also filed under
   the 65 words within one bit of it. Two members link if and only if they
   share such a word, and a word has at most 65 members.
5. Components of the links by star contraction.

Defined results: null or empty texts have the fingerprint zero and link like
any other; a document with fewer words than the shingle length is one shingle;
`component_id` is the least non-null `doc_id` reachable (null if there is
none); repeated rows keep their number; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelane.llm import golay
from bytelane.llm.components import components
from bytelane.llm.store import settle
from bytelane.llm.words import text_blocks

SHINGLE = 3
MAX_BITS = 2
BUCKET = 32
SEGMENTS = ((0, 22), (22, 21), (43, 21))
STEP = 1 << 17


def fingerprint_block(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints (uint64) of a list of texts."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        n = len(words)
        if n == 0:
            continue
        line = b" ".join(words)
        if n <= shingle:
            hashes.append(digest(line, 42))
            counts[i] = 1
            continue
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes += [digest(line[a:b], 42) for a, b in zip(
            starts[:n - shingle + 1].tolist(), ends[shingle - 1:].tolist(), strict=True)]
        counts[i] = n - shingle + 1
    values = np.array(hashes, np.uint64)
    ones = np.zeros((len(texts), 64), np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    for at in range(0, len(values), STEP):
        bits = np.unpackbits(values[at:at + STEP].view(np.uint8), bitorder="little").reshape(-1, 64)
        own = owner[at:at + STEP]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    majority = (2 * ones > counts[:, None]).astype(np.uint64)
    return (majority << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """`(id, *keep, fp)` of every row; `fp` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            fp = fingerprint_block(block.column("text").to_pylist(), shingle).view(np.int64)
            kept = [block.column(c) for c in ("id", *keep)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fp)], names=["id", *keep, "fp"])

    d = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, T.StructType([d.schema[c] for c in ("id", *keep)] + [T.StructField("fp", T.LongType())]))


def keys(distinct: DataFrame) -> DataFrame:
    """`(key, fp)`: an equal segment with a nearby Golay index of the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            part = [(fp >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
            for i in range(3):
                index, source = golay.indices(part[(i + 1) % 3])
                key = (np.uint64(i) << np.uint64(34)) | (part[i][source] << np.uint64(12)) | index.astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)[source])], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def _pairs_within(members: str):
    """Pairs `(a, b)` with at most MAX_BITS differing bits inside a small sorted array."""
    return F.explode(F.flatten(F.transform(members, lambda x, i: F.transform(
        F.filter(F.slice(F.col(members), i + 2, F.size(members)), lambda y: F.bit_count(x.bitwiseXOR(y)) <= MAX_BITS),
        lambda y: F.struct(x.alias("a"), y.alias("b"))))))


def links(distinct: DataFrame) -> DataFrame:
    """Edges `(a, b)` whose components are those of all links between distinct fingerprints."""
    k = settle(keys(distinct), "keys")
    sizes = settle(k.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    shared = settle(k.join(sizes, "key"), "shared")
    small = shared.where(F.col("n") <= BUCKET).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("members"))
    close = small.select(_pairs_within("members").alias("p")).select("p.a", "p.b").distinct()
    # one bit flipped at each place, and the word itself
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    crowded = shared.where(F.col("n") > BUCKET).select("fp").distinct()
    balls = crowded.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("word"))
    stars = balls.groupBy("word").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    wide = stars.select(F.explode("members").alias("a"), F.array_min("members").alias("b")).where("a <> b").distinct()
    return close.union(wide)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """`(id, *keep, fp, root, component_id)` of every row.

    `root` is the component's least fingerprint, its key also among rows that share an id.
    """
    fps = settle(fingerprints(docs, id_col, text_col, shingle, keep), "fps")
    distinct = settle(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    linked = components(links(distinct))
    named = distinct.join(linked, distinct["fp"] == linked["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = settle(named, "named")
    ids = settle(named.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    labels = settle(named.join(ids, "root").select("fp", "root", "component_id"), "labels")
    return fps.join(labels, "fp").select(F.col("id").alias(id_col), *keep, "fp", "root", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The row of each component with the least id (null last, then the text's hash), with all columns of `docs`."""
    d = docs.withColumn("_text_hash", F.xxhash64(text_col))
    rows = near_duplicates(d, id_col, text_col, shingle, ("_text_hash",))
    least = rows.groupBy("root").agg(F.min(F.struct(
        F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_text_hash").alias("h"))).alias("x"))
    chosen = settle(least.select(F.col("x.id").alias("_id"), F.col("x.h").alias("_h")), "chosen")
    kept = d.join(chosen, d[id_col].eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_h")), "left_semi")
    # rows repeated with id and text: one of them
    nth = F.row_number().over(Window.partitionBy(id_col, "_text_hash").orderBy(F.lit(0)))
    return kept.withColumn("_nth", nth).where("_nth = 1").select(*docs.columns)
