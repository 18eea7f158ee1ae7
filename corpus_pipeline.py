"""Corpus pipeline: toxic documents go, near-duplicates and contaminated
documents go, secrets are masked, and what stays is tokenized.

Each stage takes `(spark, docs, sf_dir)` and works on all rows its predecessor
kept; `run` writes each result as Parquet below the folder that
`spark.checkpoint.dir` names and reads it again as the next stage's input.

Rows with equal ids are handled one by one. Of a group of near-duplicates the
row with the least id stays (null ids last, then the least hash of the text).
Null texts count as empty. Columns beside `doc_id` and `text` pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytelane.llm import decontam, pieces, secrets, simhash, toxicity
from bytelane.llm.store import free_name, settle
from bytelane.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the machine learned from `labels`."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "_toxicity")
    return toxicity.score(docs, machine, name).where(F.col(name) < 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the least id."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by `benchmark`."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark."""
    name = free_name(docs, "_secrets")
    return secrets.redact(secrets.find_spans(docs, out=name), name).drop(name)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents' texts."""
    return pieces.digests(docs, pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("sentencepiece", tokenize),
]

# Learned scores and token ids have no SQL form; tests/llm compare each stage
# with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return stage_last(spark, docs, sf_dir)


def stage_last(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return settle(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
