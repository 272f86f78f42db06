"""Start streams to a table and read their outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_folder

LATENESS = "10 minutes"


def to_table(stream: DataFrame, path: str, checkpoint: str, once: bool = False, interval: str = "1 minute") -> StreamingQuery:
    """Append a stream to Parquet, exactly once. ``once`` takes what is there and ends."""
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(**trigger).start()


def drain(stream: DataFrame, purpose: str) -> DataFrame:
    """Run a stream over the data at hand into a new table of the shared folder and read it."""
    spark = stream.sparkSession
    path = shared_folder(spark, purpose)
    query = to_table(stream, f"{path}/table", f"{path}/checkpoint", once=True)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def read_output(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}").drop("batch")
