"""Documents to training tokens: quality rules, exact dedup, near-dedup, mixing, piece encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``. Extra columns are carried along; null and empty
texts fail the quality rules; an empty table gives an empty result with the last stage's columns.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from knotwork.llm import exact_dedup, mixing, near_dedup, pieces, quality_rules
from knotwork.session import remove, shared_dir

#: Some stage has no SQL form (entropy balancing, the piece lattice); the tests compare with a brute-force run.
ORACLE_SQL = None


def _rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def _pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.piece_encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


def _forget(spark: SparkSession, base: str) -> None:
    try:
        remove(spark, base)
    except Exception:  # the session has ended already, and with it what could reach the folder
        return


STAGES = [("quality_rules", _rules), ("exact_dedup", _exact), ("near_dedup", _near), ("mixing", _mix), ("sentencepiece", _pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again.

    A stage's folder goes once the next one is written, the last one when the driver's Python ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, base)
    last = None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if last:
            remove(spark, last)
        last = at
    return docs
