"""Transaction sources and sinks: CSV, Parquet, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import coerced
from ..functions.features import normalized_type
from ..schema import LABELS, TRANSACTION


def _clean_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinities to null and one spelling of ``type``; ints and flags keep their type."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            out[f.name] = F.when(~F.isnan(f.name) & (F.abs(f.name) < float("inf")), F.col(f.name))
    if "type" in df.columns:
        out["type"] = normalized_type()
    return df.withColumns(out)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Whole CSV with header; large files are split by Spark, so no chunk size is needed.

    Every field is read as text and coerced, so a bad number becomes null instead of failing
    the scan. All files must have the first one's header: another order of columns fails.
    """
    names = spark.read.options(header=True, **options).csv(path).schema
    return typed(spark.read.schema(names).options(header=True, enforceSchema=False, **options).csv(path))


def typed(raw: DataFrame) -> DataFrame:
    types = {f.name: f.dataType for f in TRANSACTION.fields}
    cols: list[Column] = [
        coerced(c, types[c].simpleString()).alias(c) if c in types else F.col(c) for c in raw.columns
    ]
    return _clean_numbers(raw.select(cols))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _clean_numbers(spark.read.parquet(path))


def stream_csv(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Incremental scan: new files of ``folder`` become micro-batches."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in TRANSACTION.fields])
    reader = spark.readStream.schema(text).options(header=True, enforceSchema=False)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return typed(reader.csv(folder))


def narrow_flags(df: DataFrame) -> DataFrame:
    """Labels as bytes, as for uploaded files."""
    return df.withColumns({c: F.col(c).cast("byte") for c in LABELS if c in df.columns})


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append_json(df: DataFrame, path: str) -> None:
    """Append-only log of JSON lines; one file per task, so writers never contend."""
    df.write.mode("append").json(path)


def append_table(df: DataFrame, path: str, time_column: str = "ts") -> None:
    """History table partitioned by day, so lookbacks prune folders."""
    df.withColumn("day", F.to_date(time_column)).write.mode("append").partitionBy("day").parquet(path)


def read_table(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Reload a history table; ``since`` (a date or timestamp) prunes day folders."""
    df = spark.read.parquet(path)
    return df.filter(F.col("day") >= F.to_date(F.lit(since))) if since is not None else df
