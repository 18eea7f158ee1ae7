"""Tables written once and read again, in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytelane.session import scratch_path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write `df` below the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation beyond this
    point, and later stages read exactly the rows that were written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{label}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, made longer until no column of `df` has it (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
