"""Registered queries of sources and sinks.

Each of them lays the given tables out as files below the checkpoint folder,
the way a user finds them (large text files, JSON documents, logs), and reads
them back through the source under test.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_right
from contextlib import contextmanager
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelane import catalog as C
from bytelane.functions import pixels as PX
from bytelane.operators import dictionary
from bytelane.operators import params as PM
from bytelane.operators import qa as QA_
from bytelane.operators import runs as R
from bytelane.operators import windows as W
from bytelane.operators.offsets import global_row_index
from bytelane.sources import append_log, corpus, json_ranges, logs, parsing, ranges, registry, samples
from bytelane.sources.tables import table
from bytelane.streaming import runner as RN
from bytelane.streaming import undo
from bytelane.streaming.endless import WindowStore, endless_windows

# fixed parameters shared with the SQL oracles
RANGE_BYTES = 50_000  # small, so that the test tables have several ranges a file
SAMPLE_BYTES = 3_000
QUESTION_RANGE = 20_000
REACH = 256
RUNS = 5
BROKEN_EVERY = 97
RESIZED = (12, 10)
IMAGES_A_FOLDER = 1_000  # on average
FOLDERS_A_READ = 100
IMAGE_TASKS_A_CORE = 4
CODE = "spark.sql.codegen.factoryMode"
BOOK = 100


def write_texts(spark: SparkSession, d: str, name: str) -> str:
    """The documents as text files, one line break after each, in the order of doc_id over the files' names."""
    path = RN.scratch(spark, name)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").select("text").write.text(path)
    return path


def q_file_ranges(spark: SparkSession, d: str) -> DataFrame:
    """IO-1: windows of large files that are read in ranges."""
    docs = ranges.corpus_from_ranges(spark, write_texts(spark, d, "texts"), None, glob="part-*", range_bytes=RANGE_BYTES)
    w, _ = W.byte_windows(docs, C.FLAGSHIP_L)
    return C._window_digest(w)


def q_question_ranges(spark: SparkSession, d: str) -> DataFrame:
    """IO-6: question documents split among tasks by their structure."""
    p = C.qa_pairs(spark, d)
    record = F.to_json(F.struct(
        F.col("conv_id").cast("int").alias("image_index"), F.col("turn").cast("int").alias("question_index"),
        F.array(F.struct(F.array(F.lit(0)).alias("inputs"), F.lit("exist").alias("function"), F.array(F.lit("]}")).alias("value_inputs"))).alias("program"),
        F.concat(F.lit("i"), F.col("conv_id").cast("string")).alias("image_filename"), "answer", "question"))
    path = RN.scratch(spark, "questions")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
    rows = p.select("conv_id", "turn", record.alias("record"))
    json_ranges.document_lines(rows, "record", ["conv_id", "turn"], '{"split": "train", "license": "[{", "version": "1", "date": ""}', "questions", parts).write.text(path)
    q = json_ranges.read_records(spark, path, QA_.QUESTION, "questions", QUESTION_RANGE)
    return q.select(
        F.col("idx").cast("bigint").alias("idx"), F.col("image_index").cast("bigint").alias("conv_id"), F.col("question_index").cast("bigint").alias("turn"),
        "image_filename", QA_.question_type().alias("kind"), "question", "answer")


class FileSamples:
    """`get_sample` of equal pieces of several files that follow one another."""

    def __init__(self, files: list[tuple[str, int]], size: int):
        self.files, self.size = files, size
        self.starts = [0, *accumulate(n for _, n in files)]

    def __len__(self) -> int:
        return -(-self.starts[-1] // self.size)

    def __call__(self, i: int) -> tuple[int, bytearray]:
        at, end, out = i * self.size, min((i + 1) * self.size, self.starts[-1]), b""
        while at < end:
            k = bisect_right(self.starts, at) - 1
            upto = min(end, self.starts[k + 1])
            with ranges.open_file(self.files[k][0]) as f:
                out += ranges.read_at(f, at - self.starts[k], upto - at)
            at = upto
        return end - i * self.size, bytearray(out)


def _file_samples(spark: SparkSession, d: str, name: str) -> type:
    files = ranges.list_ranges(spark, write_texts(spark, d, name), (1 << 31) - 1, "part-*").groupBy("path").agg(F.max("file_length").alias("n"))
    get = FileSamples([(r["path"], r["n"]) for r in files.orderBy("path").collect()], SAMPLE_BYTES)  # as many as there are shuffle partitions
    return samples.item_source(name, get, lambda: len(get), "n_bytes BIGINT, content BINARY")


def _sample_rows(df: DataFrame) -> DataFrame:
    return df.select("idx", "n_bytes", F.md5("content").alias("md5"))


def q_sample_items(spark: SparkSession, d: str) -> DataFrame:
    """U-1: a user's map-style samples (pieces of files), read by number."""
    return _sample_rows(samples.load(spark, _file_samples(spark, d, "file_samples")))


def q_sample_stream(spark: SparkSession, d: str) -> DataFrame:
    """U-1: the same samples as a stream with offsets."""
    return _sample_rows(RN.run_available(samples.stream(spark, _file_samples(spark, d, "file_sample_stream")), "samples"))


def q_append_log(spark: SparkSession, d: str) -> DataFrame:
    """IO-12: a loss log appended by two writers, one of which repeats its append; read back with the commit."""
    lg = C.loss_log(spark, d).select("run", "gpu_rank", "kind", "cum_batch", "timestamp", "loss")
    path = RN.scratch(spark, "append-log")
    for name, part in (("even", 0), ("odd", 1), ("even", 0)):
        append_log.append(lg.where(F.pmod("gpu_rank", F.lit(2)) == part), path, name)
    back = append_log.read(spark, path, lg.schema)
    return back.select("commit", "run", F.col("gpu_rank").cast("bigint").alias("gpu_rank"), "kind", "cum_batch", "timestamp", C.dec("loss").alias("loss"))


def q_live_undo(spark: SparkSession, d: str) -> DataFrame:
    """IO-11: the rows that survive undo, followed live over three micro-batches (errors undo the user's last row)."""
    ev = table(spark, d, "events").select(
        "user_id", "event_id", F.when(F.col("event_type") == "error", "undo").otherwise("put").alias("op"))
    idx, tot = global_row_index(ev, "user_id", "_n", tiebreak=["event_id"], keep=["op"])
    first = idx.groupBy("user_id").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_count"))
    ops = idx.join(first, "user_id").select(
        F.col("user_id").alias("writer_id"), (F.col("_n") - F.col("_first")).alias("seq"), "op", F.col("event_id").cast("string").alias("item"))
    ends = first.select(F.col("user_id").alias("writer_id"), F.col("_count").alias("seq"), F.lit("close").alias("op"), F.lit(None).cast("string").alias("item"))
    path = RN.scratch(spark, "undo-in")
    files = max(1, -(-tot.rows // (C.STREAM_CHUNKS * RN.ROWS_PER_FILE)))
    chunk, file = F.pmod("seq", F.lit(C.STREAM_CHUNKS)), F.pmod(F.xxhash64("writer_id"), F.lit(files))
    ops.unionByName(ends).repartition(C.STREAM_CHUNKS * files, chunk, file).write.parquet(path)
    tot.release()
    src = spark.readStream.schema(undo.OPERATIONS).option("maxFilesPerTrigger", files).parquet(path)
    left = RN.run_available(undo.live_view(src, REACH), "undo-out")
    return left.select("writer_id", F.col("item").cast("long").alias("seq"))


def q_random_stream(spark: SparkSession, d: str) -> DataFrame:
    """W-7: the first draws of an endless stream of random windows, made in five runs of one query."""
    p = C.RANDOM
    store = WindowStore(spark, write_texts(spark, d, "random-texts"), "part-*")
    out, checkpoint = RN.scratch(spark, "random-out"), RN.scratch(spark, "random-checkpoint")
    for _ in range(RUNS):
        endless_windows(store, spark, out, checkpoint, p["L"], seed=p["seed"], hash_mode="md5", draws_per_batch=p["k"] // RUNS, trigger={"availableNow": True}).awaitTermination()
    r = spark.read.schema("draw long, start long, tokens binary").parquet(out)
    return r.select("draw", "start", F.octet_length("tokens").cast("bigint").alias("n_bytes"), F.md5("tokens").alias("md5"))


def q_dense_corpus(spark: SparkSession, d: str) -> DataFrame:
    """A-13: one dense dictionary for the parts of all order lines, from 11 on."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    values = dictionary.dense_dictionary(lines, "l_partkey", C.IMG["remap_start"])
    return dictionary.encode(lines, "l_partkey", values).select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", "code")


def q_mapped_state(spark: SparkSession, d: str) -> DataFrame:
    """U-6: rows renamed, extended and kept while a state is mapped, counted in the pass that writes it."""
    src, tgt = C.state_tables(spark, d)
    state, seen = PM.mapped_state(src, tgt, C.RENAME_RULES, ["stage0.embed", "layer2"])
    said: list[str] = []
    counts = PM.write_mapped(state, seen, RN.scratch(spark, "state"), said.append)
    return spark.createDataFrame([(k, int(v)) for k, v in counts.items()], "what string, n long")


def _parse_event(line: str) -> tuple[int, int, str]:
    e = json.loads(line)
    return e["event_id"], e["user_id"], e["event_type"]


def q_parsed_lines(spark: SparkSession, d: str) -> DataFrame:
    """U-5: JSON lines through a user's parser; every 97th line is cut short and goes to the quarantine."""
    e = table(spark, d, "events")
    text = F.to_json(F.struct("event_id", "user_id", "event_type"))
    path = RN.scratch(spark, "event-lines")
    broken = F.pmod("event_id", F.lit(BROKEN_EVERY)) == 0
    e.select(F.when(broken, F.substring(text, 1, 25)).otherwise(text).alias("value")).write.text(path)
    good, bad = parsing.parse_lines(spark, path, _parse_event, "event_id BIGINT, user_id BIGINT, event_type STRING")
    none = F.lit(None)
    return good.withColumn("text", none.cast("string")).withColumn("error", none.cast("string")).unionByName(
        bad.select(none.cast("bigint").alias("event_id"), none.cast("bigint").alias("user_id"), none.cast("string").alias("event_type"), "text",
                   F.element_at(F.split("error", ":"), 1).alias("error")))


def q_resize(spark: SparkSession, d: str) -> DataFrame:
    """F-21: images of all documents resized to 12 x 10 pixels."""
    small = PX.resize_images(C.images(spark, d).where("img.height > 0"), "image_id", "img", *RESIZED)
    return small.select("image_id", C._md5_ints(F.col("img.data")).alias("data_md5"))


def png(height: int, width: int, data: bytes) -> bytes:
    """An RGB image file without filters."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + data[y * width * 3:(y + 1) * width * 3] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@contextmanager
def interpreted(spark: SparkSession):
    """Expressions of the jobs run meanwhile are interpreted: the image source generates code anew for every file it opens."""
    mode = spark.conf.get(CODE, None)
    spark.conf.set(CODE, "NO_CODEGEN")
    try:
        yield
    finally:
        spark.conf.unset(CODE) if mode is None else spark.conf.set(CODE, mode)


def q_image_files(spark: SparkSession, d: str) -> DataFrame:
    """IO-9: image files, written one for each document, read by Spark's image source.

    The files lie in folders of about `IMAGES_A_FOLDER`, and `FOLDERS_A_READ`
    folders are read at a time, so that what a read lists on the driver does
    not grow with the table.
    """
    path = RN.scratch(spark, "image-files")
    folders = -(-table(spark, d, "documents").count() // IMAGES_A_FOLDER)

    def write(batches):
        folder = append_log.Folder(path)
        for batch in batches:
            data, offsets = batch.column("data").values.to_numpy(zero_copy_only=False).astype("uint8"), batch.column("data").offsets.to_pylist()
            rows = zip(*(batch.column(c).to_pylist() for c in ("image_id", "folder", "height", "width")), offsets[:-1], offsets[1:], strict=True)
            for i, at, h, w, start, end in rows:
                # a repeated task writes the same bytes under the same name
                folder.publish(f"{at}/{i}.png", png(h, w, data[start:end].tobytes()))
            yield batch.select(["image_id"])

    for at in range(folders):
        append_log.Folder(path).make(str(at))
    im = C.images(spark, d).where("img.height > 0").select(
        "image_id", F.pmod(F.xxhash64("image_id"), F.lit(max(folders, 1))).alias("folder"), "img.height", "img.width", "img.data")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
    im.repartition(parts, "image_id").mapInArrow(write, "image_id BIGINT").write.format("noop").mode("overwrite").save()
    out = RN.scratch(spark, "image-digests")
    for first in range(0, folders, FOLDERS_A_READ):
        read = QA_.read_images(spark, [f"{path}/{at}" for at in range(first, min(first + FOLDERS_A_READ, folders))])
        # small files come as a task for every few of them
        digests = read.coalesce(IMAGE_TASKS_A_CORE * spark.sparkContext.defaultParallelism).select(
            F.element_at(F.split("image_filename", r"\."), 1).cast("bigint").alias("image_id"), F.col("height").cast("bigint").alias("height"),
            F.col("width").cast("bigint").alias("width"), F.md5(F.hex("data")).alias("bgr_md5"))
        with interpreted(spark):
            digests.write.mode("append").parquet(out)
    return spark.read.schema("image_id BIGINT, height BIGINT, width BIGINT, bgr_md5 STRING").parquet(out) if folders else spark.createDataFrame(
        [], "image_id BIGINT, height BIGINT, width BIGINT, bgr_md5 STRING")


def write_books(spark: SparkSession, d: str) -> str:
    """A corpus folder with a `train` split: one file for each `BOOK` documents, in the order of doc_id."""
    path = RN.scratch(spark, "books")
    docs = table(spark, d, "documents").select(
        "doc_id", F.lpad(F.call_function("div", F.col("doc_id"), F.lit(BOOK)).cast("string"), 12, "0").alias("book"), F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition("book").sortWithinPartitions("book", "doc_id").select("book", "text").write.partitionBy("book").text(f"{path}/train")
    return path


def q_books(spark: SparkSession, d: str) -> DataFrame:
    """IO-1 / IO-3 / U-2: the registered source `books` over a split folder."""
    docs = registry.retrieve("books")(spark, write_books(spark, d), "train", glob="part-*")
    return docs.select("doc_id", "n_bytes", F.md5("content").alias("md5"))


def q_book_texts(spark: SparkSession, d: str) -> DataFrame:
    """IO-4: the books' texts in seeded random order, as strict UTF-8."""
    docs = registry.retrieve("books")(spark, write_books(spark, d), "train", glob="part-*").withColumn("name", F.col("doc_id").cast("string"))
    texts = corpus.iter_books(docs, shuffle=True, seed=C.SHUFFLE["seed"])
    return texts.select(F.col("name").cast("bigint").alias("doc_id"), F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("md5"))


def q_masked_books(spark: SparkSession, d: str) -> DataFrame:
    """IO-2: the registered masked source over a split folder; what mask and labels hold of each window."""
    p = C.MASKED
    build = registry.retrieve("masked_books", masked=True)
    w = build(spark, write_books(spark, d), "train", seq_len=p["L"], seed=p["seed"], epoch=0, hash_mode="md5", include_tail=True,
              mask_token_id=p["mask"], masking_proba=p["p"], pad_token_id=p["pad"])
    return C.masked_digest(w)


def q_typed_lines(spark: SparkSession, d: str) -> DataFrame:
    """IO-10: JSON lines into typed records."""
    path = RN.scratch(spark, "typed-lines")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.struct("user_id", "event_type").alias("who"))
    e.write.json(path)
    back = logs.read_jsonl(spark, path, e.schema)
    return back.select("event_id", F.col("who.user_id").alias("user_id"), F.col("who.event_type").alias("event_type"), C.dec("value").alias("value"))


def q_artefacts(spark: SparkSession, d: str) -> DataFrame:
    """A-10: the files that runs left behind, listed from a folder, against the runs' configurations.

    Each user with a purchase is a run: its purchases are its checkpoints, and
    every third user's run has lost its configuration file.
    """
    path = RN.scratch(spark, "artefacts")
    e = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id")
    runs = e.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    own = [("loss.csv", F.lit(True)), ("config.yaml", F.pmod("user_id", F.lit(3)) > 0), ("train.log", F.lit(True))]
    names = e.select("user_id", F.concat("event_id", F.lit(".pth")).alias("name"))
    for name, there in own:
        names = names.unionByName(runs.where(there).select("user_id", F.lit(name).alias("name")))
    # the listing is what a run tracker exports: one path a line
    names.select(F.concat(F.lit("/runs/"), "user_id", F.lit("/"), "name")).write.text(path)
    listing = spark.read.text(path).select(F.col("value").alias("path"), F.element_at(F.split("value", "/"), -2).cast("bigint").alias("run"))
    configs = runs.select(F.col("user_id").alias("run"), (F.col("n") - F.pmod("user_id", F.lit(2))).cast("int").alias("num_models_to_save"))
    out = R.artefact_check(listing, "run", configs)
    return out.select("run", F.col("n_checkpoints").cast("bigint").alias("n_checkpoints"), "has_loss_csv", "has_config", "has_train_log", "checkpoints_ok")


QUERIES = {
    "file_ranges": q_file_ranges,
    "question_ranges": q_question_ranges,
    "sample_items": q_sample_items,
    "sample_stream": q_sample_stream,
    "append_log": q_append_log,
    "live_undo": q_live_undo,
    "random_stream": q_random_stream,
    "dense_corpus": q_dense_corpus,
    "mapped_state": q_mapped_state,
    "parsed_lines": q_parsed_lines,
    "resize": q_resize,
    "image_files": q_image_files,
    "books": q_books,
    "book_texts": q_book_texts,
    "masked_books": q_masked_books,
    "typed_lines": q_typed_lines,
    "artefacts": q_artefacts,
}
