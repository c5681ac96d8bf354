"""From raw documents to packed training sequences: quality, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of documents. Results are written as Parquet between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestra.llm import minhash, packing, pii, quality
from attestra.llm.common import materialize
from attestra.llm.queries import tokenizer_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored as empty ones, repeated rows alike; rows without a doc_id are scored and never learned from.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8 or more) the document with the smallest id stays.

    Rows are compared, whatever their ids; of equal ids the row with the least hash stays. Rows without words all stay.
    """
    return minhash.drop_near_duplicates(docs, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; null and empty texts stay as they are."""
    return pii.redact_pii(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 4096 tokens; a null text is empty, one token."""
    return packing.packed_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_documents),
    ("near duplicates", distinct_documents),
    ("personal data", without_personal_data),
    ("packing", packed_sequences),
]

#: SQL can't express these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
