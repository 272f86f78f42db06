"""Session helpers: settings, shared scratch folder, lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new sub-folder of the cluster's shared folder (``spark.checkpoint.dir``).

    Only a single-process local master may fall back to a temporary folder; elsewhere
    the setting is required, since executors must all see what is written there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="ledgerlens-")
    return f"{root.rstrip('/')}/ledgerlens/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, purpose: str = "cut") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ensure_checkpoint_folder(spark: SparkSession) -> None:
    """Let iterative MLlib algorithms checkpoint to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))
