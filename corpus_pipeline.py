"""The corpus pipeline: stages that each take and give documents, the last one packed pieces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tideglass.llm import linededup, mixing, packing, quality, simhash
from tideglass.llm.common import discard, read, scope, shared_dir


#: Rows of one Arrow batch between executors and their Python workers. Operators take texts in hundreds; of Spark's 10,000 the JVM's native pools and
#: every worker keep room for whole batches, stage after stage.
BATCH = 1000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH rows if they are larger. A stage's result is computed when it is written, so this stays set after
    a stage; :func:`run` puts back what it found."""
    if not 0 < int(spark.conf.get(_BATCH_ROWS)) <= BATCH:
        spark.conf.set(_BATCH_ROWS, BATCH)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.drop_near_duplicates(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mixing", mix_stage), ("packing", pack_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again, and the tables it made meanwhile go, as does the result of
    the stage before it."""
    docs, before, rows = read(spark, sf_dir, "documents"), None, spark.conf.get(_BATCH_ROWS)
    try:
        for name, stage in STAGES:
            path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            with scope(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
            if before:
                discard(spark, before)
            docs, before = spark.read.parquet(path), path
    finally:
        spark.conf.set(_BATCH_ROWS, rows)
    return docs
