"""The corpus pipeline: language ID, near duplicates, repeated passages, PII, packing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; run()
writes each stage's result as Parquet in the shared checkpoint folder and reads
it again. All stages but the last return the columns of documents, whatever
these are besides doc_id, text, lang and source.

Null texts are empty: the first stage rejects them. Rows with a null doc_id
come before or after no other: they are never dropped or cut as a repeat, but the
first stage decides on them as on all. Empty tables stay empty.

A stage's intermediate tables are removed when the next stage begins, unless its
docs still read them; so write or consume a stage's result before going on.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import best_fit, lang_id, near_dup, passages, pii, registry
from driftline.llm.common import SCRATCH, folder, ready, release, table


_scratch: list[str] = []


def _stage(f):
    """f, and before it goes the intermediate tables of earlier stages, which are written by now, or read by docs."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ready(spark)
        _scratch[:] = release(spark, _scratch, docs)
        before = {*SCRATCH}
        try:
            return f(spark, docs, sf_dir)
        finally:
            _scratch.extend(p for p in SCRATCH if p not in before)

    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language can't be told. Rows of one doc_id are decided on by their own texts."""
    return lang_id.keep_accepted(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates of similarity 0.8 or more, that with the smallest doc_id."""
    return near_dup.drop_near_duplicates(docs, percent=80)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut."""
    return passages.remove_passages(docs)


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are generalised or removed."""
    return pii.clean_documents(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, packed into sequences, with their ids."""
    return best_fit.packed(docs, registry.tokenizer("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("packing", packing)]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    home = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)  # the result is read until then
    docs, last = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        out = f"{home}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        # What the stage has read isn't needed any more, nor are its intermediate tables.
        _scratch[:] = release(spark, _scratch + last, docs)
        last = [out]
    return docs
