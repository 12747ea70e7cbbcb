"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage works on all documents that the one before kept, and all but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrain.llm import cotrain, decontam, neardup, packing, secrets
from proofgrain.llm.common import staged, table

TOKENIZER = "word_bpe_49k.json"
NEAR = 80  # percent of shared five-word shingles
BATCH = 1_000  # documents that Spark sends to Python at once


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views call low in quality or toxic go."""
    return cotrain.good_documents(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, the one of the smallest doc_id stays."""
    return neardup.one_of_each(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more in benchmark windows go."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced, and n_chars follows."""
    return secrets.redact(docs, others=secrets.OTHERS).withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, packed into sequences."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", reject_bad), ("near duplicates", one_of_each_group), ("benchmark decontamination", drop_contaminated),
    ("secret scan", redact_secrets), ("packing", pack)]

#: Fitted views, tokenization and packing cannot be said in SQL; tests hold the rows against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents are long rows: smaller batches bound what a task and its Python side hold
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
