"""Retention that deletes: tables in folders by day, from which old days leave the disk.

A day is replaced as a whole (dynamic partition overwrite), so writing one again leaves no copies and touches no other
day. Dropping removes the folders of past days without reading them and rewrites only the day that the limit cuts.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

DAY = "day"


def write_days(df: DataFrame, folder: str, at: Column) -> None:
    """Write rows by the day of ``at``, replacing the days they hold; rows without a time share a folder that is never dropped."""
    dealt = df.withColumn(DAY, F.to_date(at)).hint("rebalance", DAY)  # splits a large day over several files
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(folder)


def _listing(spark: SparkSession, folder: str):
    """The folder's file system and its day folders by day, from one listing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for status in store.listStatus(path) if store.exists(path) else []:
        name = status.getPath().getName()
        try:
            found[datetime.date.fromisoformat(name.removeprefix(f"{DAY}="))] = status.getPath()
        except ValueError:  # rows without a time, or files of the writer
            continue
    return store, found


def days_held(spark: SparkSession, folder: str) -> list[datetime.date]:
    return sorted(_listing(spark, folder)[1])


def read_days(spark: SparkSession, folder: str) -> DataFrame:
    """The table with its ``day``; a filter on it prunes folders."""
    return spark.read.option("basePath", folder).parquet(folder)


def drop_before(spark: SparkSession, folder: str, limit, at: Column) -> list[datetime.date]:
    """Delete rows whose ``at`` lies before ``limit`` (a timestamp, its text or a column of one); the days removed as a whole.

    ``at`` is the time the table was written by.
    """
    moment = (limit if isinstance(limit, Column) else F.lit(limit)).cast("timestamp")
    first = spark.range(1).select(F.to_date(moment)).first()[0]  # in the session's time zone, as the days are
    store, found = _listing(spark, folder)
    if first in found:
        day = read_days(spark, folder).where(F.col(DAY) == F.lit(first))
        kept = cut_lineage(day.where(at >= moment).drop(DAY), "kept")  # a copy: the day is replaced below
        if kept.isEmpty():
            store.delete(found[first], True)
        else:
            write_days(kept, folder, at)
    gone = sorted(d for d in found if d < first)
    for d in gone:
        store.delete(found[d], True)
    spark.catalog.refreshByPath(folder)
    return gone
