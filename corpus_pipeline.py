"""From raw documents to packed sequences: language ID, quality, near-duplicates, secrets, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vulnweave.llm import langid, packing, quality, secrets, simhash
from vulnweave.llm._common import checkpoint_dir, table
from vulnweave.llm.queries import tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a known language stay; null texts, those without a letter and those that no language fits go."""
    return langid.keep_known(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the scorer takes as good stay."""
    return quality.keep_good(docs)


def simhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group stays; documents link at a similarity of 0.8 or more of their five-word shingles."""
    return simhash.keep_one(docs, width=5, least=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: a row for each piece of each document."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("simhash_neardup", simhash_neardup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models, shingle hashes and a tokenizer decide here: SQL cannot express the stages. A test applies brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each but the last is written as Parquet in the shared folder and read again; at the end only the last of these is left."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}", None
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{n}-{name}")
            docs = spark.read.parquet(path)
            if before:  # what the stage has read isn't needed any more
                gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
                gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
            before = path
    return docs
