"""Queries of the operators for training data, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroids, decontaminate, importance, language_id, license_scan, near_dedup, neighbours, packing, sharding, suffix_dedup,
    token_counts, toxicity, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_token_counts")
def token_count_query(spark, sf_dir):
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), limit=2048)


@_query("op2_packing")
def packing_query(spark, sf_dir):
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), capacity=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query("op3_license_scan", license_scan.scan_sql())
def license_query(spark, sf_dir):
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("matches")


@_query("op4_warc", warc.round_trip_sql())
def warc_query(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


@_query("op5_suffix_dedup", suffix_dedup.repeated_spans_sql())
def suffix_query(spark, sf_dir):
    return suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents")).drop("text_hash")


@_query("op6_neighbours")
def neighbour_query(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", k=20)


@_query("op7_sharding", sharding.shard_documents_sql())
def sharding_query(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=8)


@_query("op8_decontamination")
def decontamination_query(spark, sf_dir):
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op9_near_dedup", near_dedup.near_duplicates_sql(3, 85))
def near_dedup_query(spark, sf_dir):
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id",
                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@_query("op10_language_id")
def language_query(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(documents.where(~out))
    named = documents.select("doc_id", out.alias("held_out"), language_id.identify(model, F.col("text")).alias("found"))
    return named.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"),
                        F.col("found.rejected").alias("rejected"))


@_query("op11_toxicity")
def toxicity_query(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language_id.held_out(F.col("doc_id"))
    model = toxicity.fit(documents.where(~out), _table(spark, sf_dir, "labels"))
    return documents.select("doc_id", out.alias("held_out"), toxicity.score(model, F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int"))


@_query("op12_importance_resampling", importance.resample_sql())
def importance_query(spark, sf_dir):
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op13_centroid_clustering", centroids.cluster_embeddings_sql())
def clustering_query(spark, sf_dir):
    return centroids.cluster_embeddings(_table(spark, sf_dir, "embeddings"))
