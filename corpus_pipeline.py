"""From raw documents to packed training sequences: five stages, each an operator of ``tarnfold.llm``.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame, which is written as
Parquet and read again as the next one's documents. All but the last return the columns of ``documents``.

    quality         rows that the rule ensemble scores below 0.3 go
    near_duplicates one row of each component stays; links have a Jaccard similarity of 0.8 or more of their five-word shingles (candidates: SimHash,
                    8 bits)
    decontaminate   rows that hold four fifths of a benchmark item's five-word shingles go
    personal_data   spans found are replaced by their kind; n_chars follows
    pack            pieces of at most 2048 tokens in sequences
"""

from __future__ import annotations

import tempfile
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarnfold.llm import leaks, packing, pii, quality, simhash
from tarnfold.llm.common import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, count_col="n_chars" if "n_chars" in docs.columns else None)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicates_stage), ("decontaminate", decontaminate_stage),
          ("personal_data", personal_data_stage), ("pack", pack_stage)]

#: Fitted rules, tokenizers and graph components have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    """A new folder that every executor can reach: in spark.checkpoint.dir, or a temporary one if the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
        base = tempfile.mkdtemp(prefix="tarnfold-pipeline-")
    return f"{base.rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), _folder(spark)
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
