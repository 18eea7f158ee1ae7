"""A corpus-wide dense dictionary of values (A-13).

`functions.pixels.dense_remap` numbers the values of one array. Here all rows
share one dictionary: the distinct values in order, numbered from
`range_start` without gaps.

1. Values are counted (partial aggregation, so a value in a third of the rows
   is one row a task).
2. Their dense ranks come from a prefix sum over range buckets of the distinct
   values, not from a window over all of them.
3. Rows get their code by a join. Values that hold more than one row in
   `HEAVY` are fewer than `HEAVY`, whatever the size of the data; they are
   broadcast, and their rows stay where they are. The others are joined by
   shuffle, in which no value is heavy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelane.operators.offsets import global_row_index
from bytelane.session import written

HEAVY = 1000


def dense_dictionary(df: DataFrame, value: str, range_start: int = 0) -> DataFrame:
    """`(value, code, n)`: every distinct value in order with its code and number of rows; null has none."""
    counts = written(df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")), "values")
    ranked, totals = global_row_index(counts, "value", "_rank", keep=["n"])
    out = written(ranked.select("value", (F.col("_rank") + F.lit(range_start).cast("long")).alias("code"), "n"), "dictionary")
    totals.release()
    return out


def encode(df: DataFrame, value: str, dictionary: DataFrame, out: str = "code") -> DataFrame:
    """`df` with the code of its values; a null, or a value that the dictionary lacks, has a null code."""
    total = int(dictionary.agg(F.sum("n")).first()[0] or 0)
    named = dictionary.select(F.col("value").alias("_value"), F.col("code").alias(out), (F.col("n") * HEAVY > total).alias("_heavy"))
    heavy = F.broadcast(named.where("_heavy").drop("_heavy"))
    rows = df.join(heavy, df[value] == F.col("_value"), "left")
    light = named.where("not _heavy").select(F.col("_value").alias("_light"), F.col(out).alias("_code"))
    open_ = F.col("_value").isNull() & F.col(value).isNotNull()
    done = rows.where(~open_).drop("_value")
    found = rows.where(open_).drop("_value", out).join(light, F.col(value) == F.col("_light"), "left").drop("_light").withColumnRenamed("_code", out)
    return done.unionByName(found)


def decode(df: DataFrame, code: str, dictionary: DataFrame, out: str = "value") -> DataFrame:
    """The way back: codes to values."""
    turned = dictionary.select(F.col("code").alias("value"), F.col("value").alias("code"), "n")
    return encode(df, code, turned, out)
