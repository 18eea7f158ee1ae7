"""Question / image / answer records (IO-6 .. IO-9, J-1 .. J-3, J-8, F-26).

Questions live in one JSON document with the records under `questions`. Small
documents are parsed whole, one by a task; `split=True` cuts large ones by
their structure (`sources.json_ranges`). Images are processed once per distinct file and then joined to
their (many) questions by file name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytelane.functions.hashing import hash_bits
from bytelane.functions.tokens import TokenIds

# fixed values: answer -> one-character class code (28 entries)
ANSWER_CLASS_MAP = {
    "0": "0", "1": "1", "2": "2", "3": "3", "4": "4", "5": "5", "6": "6", "7": "7", "8": "8", "9": "9",
    "10": "A", "blue": "B", "brown": "C", "cube": "D", "cyan": "E", "cylinder": "F", "gray": "G",
    "green": "H", "large": "I", "metal": "J", "no": "K", "purple": "L", "red": "M", "rubber": "N",
    "small": "O", "sphere": "P", "yellow": "Q", "yes": "R",
}

# fixed values: program function -> question type (13 entries)
QUESTION_TYPES = {
    "exist": "exists",
    "count": "count",
    "equal_integer": "compare_integer",
    "less_than": "compare_integer",
    "greater_than": "compare_integer",
    "query_color": "query_attribute",
    "query_material": "query_attribute",
    "query_size": "query_attribute",
    "query_shape": "query_attribute",
    "equal_size": "compare_attribute",
    "equal_material": "compare_attribute",
    "equal_shape": "compare_attribute",
    "equal_color": "compare_attribute",
}

# fixed values: record limits of the question set
MAX_QUESTION_LEN_BYTES = 205
MAX_ANSWER_LEN_BYTES = 8

PROGRAM_STEP = T.StructType(
    [
        T.StructField("inputs", T.ArrayType(T.IntegerType())),
        T.StructField("function", T.StringType()),
        T.StructField("value_inputs", T.ArrayType(T.StringType())),
    ]
)
QUESTION = T.StructType(
    [
        T.StructField("image_index", T.IntegerType()),
        T.StructField("program", T.ArrayType(PROGRAM_STEP)),
        T.StructField("question_index", T.IntegerType()),
        T.StructField("image_filename", T.StringType()),
        T.StructField("question_family_index", T.IntegerType()),
        T.StructField("split", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("question", T.StringType()),
    ]
)
QUESTION_FILE = T.StructType(
    [
        T.StructField(
            "info",
            T.StructType([T.StructField(n, T.StringType()) for n in ("split", "license", "version", "date")]),
        ),
        T.StructField("questions", T.ArrayType(QUESTION)),
    ]
)


def read_questions(spark: SparkSession, path: str, partitions: int | None = None, split: bool = False) -> DataFrame:
    """IO-6: records of one or several question files with their 0-based index `idx`.

    The index runs on over the files, in the order of their paths. `split`:
    by as many tasks as a file has ranges, instead of one a file.
    """
    if split:
        from bytelane.sources.json_ranges import read_records

        return read_records(spark, path, QUESTION, "questions")
    from bytelane.operators.offsets import prefix_sum

    doc = spark.read.schema(QUESTION_FILE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    doc = doc.select(F.col("_metadata.file_path").alias("_file"), "questions")
    starts, _ = prefix_sum(doc.select("_file", F.size("questions").alias("_n")), "_file", "_n", "_start")
    recs = doc.join(starts.select("_file", "_start"), "_file").select("_start", F.posexplode("questions").alias("_pos", "q"))
    recs = recs.select((F.col("_start") + F.col("_pos")).cast("int").alias("idx"), "q.*")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
    return recs.repartition(n, "idx")


def raw_record(questions: DataFrame, idx: int, split: str) -> DataFrame:
    """IO-7: one record by index; the test split has no answers and is refused."""
    if split == "test":
        raise ValueError("the test split has no answers and cannot be sampled")
    return questions.where(F.col("idx") == idx)


def iter_records(
    questions: DataFrame, *, shuffle: bool = False, seed: int = 0, max_items: int | None = None, hash_mode: str = "xxhash64",
    images: DataFrame | None = None, key: str = "image_filename",
) -> DataFrame:
    """IO-8: records in index or seeded random order, at most `max_items` (a limit is the feature).

    With `images` the records come in parts, `(idx, question, answer,
    *image columns)`: the picked questions meet their images (J-1) without any
    processing, so no image is moved that isn't asked for.
    """
    order = [hash_bits(F.lit(seed), F.col("idx"), mode=hash_mode), F.col("idx")] if shuffle else [F.col("idx")]
    out = questions.orderBy(*order)
    out = out.limit(max_items) if max_items else out
    if images is None:
        return out
    parts = join_images(out.select("idx", "question", "answer", key), images, key)
    return parts.orderBy(*order).select("idx", "question", "answer", *[c for c in images.columns if c != key])


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """IO-9: image files decoded by Spark's image source, one row per file.

    `path`: a folder or several; more than 32 are listed side by side.

    An unreadable file is an error. Files of different folders may share a
    name: `image_path` tells them apart, and `join_images` refuses a name that
    stands for two images.
    """
    img = spark.read.format("image").option("dropInvalid", False).load(path)
    readable = F.assert_true(F.col("image.nChannels") > 0, F.concat(F.lit("unreadable image "), F.col("image.origin")))
    return img.where(readable.isNull()).select(
        F.element_at(F.split("image.origin", "/"), -1).alias("image_filename"),
        F.col("image.origin").alias("image_path"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("n_channels"),
        F.col("image.data").alias("data"),
    )


def iter_images(images: DataFrame, *, shuffle: bool = False, seed: int = 0, max_items: int | None = None) -> DataFrame:
    """IO-9: distinct images in name or seeded random order."""
    order = [hash_bits(F.lit(seed), F.col("image_filename")), F.col("image_filename")] if shuffle else [F.col("image_filename")]
    out = images.orderBy(*order)
    return out.limit(max_items) if max_items else out


def join_images(questions: DataFrame, processed_images: DataFrame, key: str = "image_filename") -> DataFrame:
    """J-1: each question with its (already processed) image; many questions per image.

    Images are processed before the join, once per file. The join is a
    shuffle join on the file name: image tables grow with the data set. A
    question whose image is missing, or whose image name is taken twice, is an
    error.
    """
    copies = processed_images.groupBy(key).agg(F.count(F.lit(1)).alias("_copies"))  # names only: no pixel is moved for the check
    checked = questions.join(copies, key, "left")
    found = F.assert_true(F.coalesce(F.col("_copies"), F.lit(0)) == 1, F.concat(F.lit("no single image for "), F.col(key).cast("string")))
    return checked.where(found.isNull()).drop("_copies").join(processed_images, key)


def answer_codes(df: DataFrame, answer: str = "answer", *, strict: bool = True) -> Column:
    """J-2: answer -> one-character class; an unknown answer is an error when strict."""
    m = F.create_map(*[F.lit(x) for kv in ANSWER_CLASS_MAP.items() for x in kv])
    code = F.try_element_at(m, F.col(answer))
    if strict:
        return F.when(F.assert_true(code.isNotNull(), "unknown answer").isNull(), code)
    return code


def question_type(program: str = "program") -> Column:
    """J-3: the type of a question is decided by the last function of its program (null if unlisted)."""
    m = F.create_map(*[F.lit(x) for kv in QUESTION_TYPES.items() for x in kv])
    return F.try_element_at(m, F.element_at(F.col(program), -1)["function"])


def token_collisions(tokens: DataFrame, token_col: str, ids: TokenIds) -> DataFrame:
    """J-8 (Q13): special ids that also occur as ordinary values in the data.

    Distinct values are computed with partial aggregation before the semi join
    against the (tiny) special-id table.
    """
    spark = tokens.sparkSession
    specials = spark.createDataFrame(
        [(n, v) for n, v in (("pad", ids.pad), ("eom", ids.eom), ("som_text", ids.som_text), ("som_image", ids.som_image)) if v is not None],
        "token STRING, id BIGINT",
    )
    values = tokens.select(F.explode(token_col).alias("v")).select(F.col("v").cast("bigint").alias("id"))
    seen = values.groupBy("id").agg(F.count(F.lit(1)).alias("occurrences"))
    return F.broadcast(specials).join(seen, "id", "inner")


def byte_profile(df: DataFrame, group: list[str], text: str, limit: int = MAX_QUESTION_LEN_BYTES) -> DataFrame:
    """F-26: byte lengths per group against a record limit."""
    n = F.octet_length(text)
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(n).cast("bigint").alias("max_bytes"),
        F.round(F.avg(n), 6).alias("avg_bytes"),
        F.count_if(n > F.lit(limit)).alias("n_over_limit"),
    )
