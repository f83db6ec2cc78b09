"""The corpus pipeline: documents to token ids in five stages, each written as Parquet and read again.

1 quality rules: documents that the cascade rejects go.
2 near-duplicates: of each group of linked fingerprints the document of the smallest id stays.
3 decontamination: documents that hold a benchmark item go.
4 secrets: their spans are masked in the text; n_chars follows.
5 encoding: doc_id and the piece ids of the text.

A stage sets Spark's Arrow batches to ROWS_AT_ONCE rows at most, for itself and what follows in the session.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, pieces, quality, secret_scan, simhash
from quern.llm.common import stage

#: Texts that a Python worker is handed at once: they are held several times, by the executor, in Arrow and as strings.
ROWS_AT_ONCE = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _few_at_once(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(function)
    def stage_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        now = int(spark.conf.get(_BATCH))
        if not 0 < now <= ROWS_AT_ONCE:
            spark.conf.set(_BATCH, str(ROWS_AT_ONCE))
        return function(spark, docs, sf_dir)

    return stage_of


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.cascade(docs).where(F.col("failed_rule").isNull()).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs.select("doc_id", "text")).select("doc_id", "piece_ids")


STAGES = [
    (name, _few_at_once(function))
    for name, function in (
        ("quality", quality_rules),
        ("near_dedup", near_dedup),
        ("decontamination", decontaminate),
        ("secrets", mask_secrets),
        ("encoding", encode_pieces),
    )
]

#: Fingerprints, templates and merges have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
