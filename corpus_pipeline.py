"""A corpus pipeline of five stages: quality classifier, near-dedup, benchmark decontamination, PII, packing.

Each stage takes all that its predecessor kept; run() writes every stage's result to shared storage and
reads it again, so a lost executor repeats a part of one stage only.

Edge cases: null, empty and wordless texts are judged by the classifier like any other, are never duplicates or contaminated, and are
packed as an end id alone; rows with a null doc_id pass through all stages; of rows equal in doc_id and text one stays; columns
of documents pass unchanged to the last stage, whatever their names (n_chars follows the text where it changes); an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.decontaminate import decontaminated
from quillspark.llm.near import deduplicated
from quillspark.llm.pack import packed
from quillspark.llm.pii import without_pii
from quillspark.llm.quality import accepted
from quillspark.llm.work import stored
from quillspark.storage import temporary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates."""
    return without_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packed(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("packing", packing)]

#: SQL can express neither the classifier, the sampling nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of all documents that the stages keep."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with temporary() as made:  # what a stage keeps for itself goes when its result is stored, and so does its predecessor's result
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
            result = made.pop()
            if before:
                made.append(before)
            before = result
    return docs
