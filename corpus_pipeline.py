"""From raw documents to packed token sequences, in five stages of the training-data operators.

Each stage reads what the one before has written. The first four return the columns of
documents; the last returns the packed pieces with their token ids. Every stage defines null,
empty, very long, tied and repeated rows through its operator (see the modules); an empty
table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, language_id, near_dedup, packing, suffix_dedup
from ledgerlens.llm.store import settle

ORACLE_SQL = None  # no stage can be expressed in SQL; tests compare each with a brute-force version


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the nearest-centroid classifier, learned from labelled rows, rejects."""
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return docs.where(~language_id.identify(model, F.col("text"))["rejected"])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group linked at 80 % of five-word shingles."""
    return near_dedup.keep_first(docs, size=5, percent=80)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words and more that occur in an earlier place; drop texts left blank."""
    return suffix_dedup.remove_repeats(docs, length="n_chars" if "n_chars" in docs.columns else None)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item within its edit budget."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return docs.where(~decontaminate.contaminated(F.col("text"), items))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, capacity=2048, end_id=1)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", without_near_duplicates),
    ("suffix_dedup", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
