"""Byte corpus sources (IO-1 .. IO-5).

A corpus is a DataFrame `(doc_id BIGINT, name STRING, content BINARY
[, n_bytes BIGINT])`; its
order is the order of `doc_id`, which the caller chooses (the reference reads
files in directory-listing order, which is arbitrary).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelane.functions.bytes import bytes_to_text_strict, text_to_bytes
from bytelane.functions.hashing import hash_bits

PART_BYTES = 4 << 20  # of contents in a task of `small_parts`

# fixed values: split name -> folder name, per dataset family
SPLIT_FOLDERS = {
    "books": {"train": "train", "valid": "validation", "test": "test"},
    "qa": {"train": "train", "valid": "val", "test": "test"},
}


def split_folder(split: str, family: str = "books") -> str:
    """IO-3: the folder (or file-name part) that holds a split."""
    try:
        return SPLIT_FOLDERS[family][split]
    except KeyError as err:
        raise ValueError(f"unknown split {split!r} for {family!r}") from err


def corpus_from_table(df: DataFrame, key: str, text: str, name: str | None = None, charset: str = "UTF-8") -> DataFrame:
    """A text table as a byte corpus (F-1 on every row)."""
    name_col = F.col(name).cast("string") if name else F.col(key).cast("string")
    cols = [
        F.col(key).cast("bigint").alias("doc_id"),
        name_col.alias("name"),
        text_to_bytes(text, charset).alias("content"),
    ]
    if charset.upper().replace("-", "") == "UTF8":
        # Spark strings are UTF-8 already: the byte length needs no encoding
        cols.append(F.octet_length(text).cast("bigint").alias("n_bytes"))
    return df.select(*cols)


def small_parts(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The corpus dealt over tasks of about `part_bytes` of contents each.

    An Arrow function gets up to 10,000 rows at once, whatever they hold; where
    each byte becomes an integer there and on the way back, a task of few bytes
    is what bounds its memory, and that of the JVM beside it. Rows are dealt in
    turn, so that neither repeated keys nor long documents meet in one task.
    """
    total = docs.agg(F.sum(F.octet_length("content").cast("bigint"))).first()[0] or 0
    parts = -(-total // part_bytes)
    return docs.repartition(parts) if parts > 1 else docs


def corpus_from_files(
    spark: SparkSession,
    root: str,
    split: str = "train",
    *,
    family: str = "books",
    glob: str | None = None,
    order: str = "path",
) -> DataFrame:
    """IO-1 / IO-3: every file of a split folder as one document.

    `order="path"` orders documents by their path (a stable rule instead of
    the listing order); `order="hash"` orders them by a hash of the path (then
    the path), which spreads similar names. `doc_id` is the dense position in
    that order, so it is unique whatever the hashes are. `n_bytes` is the
    listed file length: offsets need no file to be opened. Files can be up to
    2 GB each.
    """
    if order not in ("path", "hash"):
        raise ValueError(f"unknown order {order!r}")
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(f"{root.rstrip('/')}/{split_folder(split, family)}")
    named = files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.col("length").alias("n_bytes"))
    from bytelane.operators.offsets import global_row_index, join_small_or_shuffle

    if order == "hash":
        keyed = named.select(hash_bits(F.col("path")).alias("_h"), "path")
        idx, tot = global_row_index(keyed, "_h", "doc_id", tiebreak=["path"])
        idx = idx.drop("_h")
    else:
        idx, tot = global_row_index(named.select("path"), "path", "doc_id")
    # the (path -> index) lookup is broadcast only below a checked file count;
    # beyond it the lookup side is hashed and the contents are shuffled once
    located = join_small_or_shuffle(named, idx, "path", tot.rows, max_broadcast_rows=500_000)
    return located.select(F.col("doc_id").cast("bigint"), "name", "content", "n_bytes")


def masked_corpus_options(mask_token_id: int = -100, masking_proba: float = 0.15, pad_token_id: int = -101) -> dict:
    """IO-2: validated options of the masked corpus."""
    if mask_token_id == pad_token_id:
        raise ValueError("mask and padding need two different ids")
    if not 0.0 <= masking_proba <= 1.0:
        raise ValueError("masking_proba must lie in [0, 1]")
    return {"mask_token_id": mask_token_id, "masking_proba": masking_proba, "pad_token_id": pad_token_id}


def iter_books(corpus: DataFrame, *, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """IO-4: `(name, text)` decoded as strict UTF-8, in corpus or seeded random order."""
    out = corpus.select("doc_id", "name", bytes_to_text_strict("content").alias("text"))
    order = hash_bits(F.lit(seed), F.col("doc_id")) if shuffle else F.col("doc_id")
    return out.orderBy(order, "doc_id").select("name", "text")


def book(corpus: DataFrame, name: str) -> str:
    """IO-5: the text of one document by name; ValueError when absent."""
    rows = corpus.where(F.col("name") == name).select(bytes_to_text_strict("content").alias("t")).limit(1).collect()
    if not rows:
        raise ValueError(f"no document is named {name!r}")
    return rows[0]["t"]


def bucket_corpus(docs: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write a corpus once as a table bucketed and sorted by `doc_id`; return it.

    Every later join on `doc_id` (the offsets lookup of W-1/W-3, per epoch and
    offset) then shuffles only the small side: the document contents stay
    where they were written. This is the layout to use when a corpus has too
    many documents for the offsets to be broadcast. The table files go to
    `path`, by default below the session's checkpoint folder (the shared
    folder named by `spark.checkpoint.dir` on a cluster).
    """
    from bytelane.session import ensure_checkpoint_dir

    spark = docs.sparkSession
    location = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}"
    (
        docs.write.bucketBy(buckets, "doc_id")
        .sortBy("doc_id")
        .mode("overwrite")
        .option("path", location)
        .saveAsTable(name)
    )
    return spark.table(name)
