"""Model-run table: one row per registered model.

Columns: model_id, model_name, model_type, version, status, tags (array), created_at,
size_bytes and a metrics map. Rows are appended or rewritten as small tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values ------------------------------------------------------------------
STATUSES = ["training", "validation", "staging", "production", "archived", "deprecated"]
LAYOUT = ("model_id string, model_name string, model_type string, version string, status string, "
          "tags array<string>, created_at timestamp, size_bytes bigint, metrics map<string,double>")


def version_number(version: str = "version") -> Column:
    return F.regexp_extract(version, r"^v?(\d+)", 1).try_cast("int")


def next_versions(runs: DataFrame) -> DataFrame:
    """(model_name, next_version): one above the highest major version."""
    return runs.groupBy("model_name").agg(
        F.concat(F.lit("v"), (F.coalesce(F.max(version_number()), F.lit(0)) + 1).cast("string"), F.lit(".0.0")).alias("next_version")
    )


def register(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Append new runs (without version) under the next versions of their name, by time and id."""
    order = F.row_number().over(Window.partitionBy("model_name").orderBy("created_at", "model_id"))
    base = F.coalesce(version_number("next_version"), F.lit(1)) - 1
    numbered = new.withColumn("_n", order).join(next_versions(runs), "model_name", "left").withColumn(
        "version", F.concat(F.lit("v"), (base + F.col("_n")).cast("string"), F.lit(".0.0"))
    )
    return runs.unionByName(numbered.select(runs.columns))


def set_status(runs: DataFrame, model_id: str, status: str) -> DataFrame:
    """The table with one run's status changed."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status}")
    return runs.withColumn("status", F.when(F.col("model_id") == model_id, status).otherwise(F.col("status")))


def add_tags(runs: DataFrame, model_id: str, tags: Sequence[str]) -> DataFrame:
    """The table with tags added to one run, each once."""
    more = F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in tags]).cast("array<string>"))
    return runs.withColumn("tags", F.when(F.col("model_id") == model_id, more).otherwise(F.col("tags")))


def delete(runs: DataFrame, model_id: str, force: bool = False) -> DataFrame:
    """The table without one run; a run in production stays unless forced."""
    gone = F.col("model_id") == model_id
    if not force:
        gone = gone & (F.coalesce("status", F.lit("")) != "production")
    return runs.filter(~F.coalesce(gone, F.lit(False)))


def list_models(runs: DataFrame, name: str | None = None, kind: str | None = None, status: str | None = None,
                tags: Sequence[str] = ()) -> DataFrame:
    """Filtered runs; a run must carry all the tags. Order by ``created_at`` descending to show."""
    for column, value in (("model_name", name), ("model_type", kind), ("status", status)):
        if value is not None:
            runs = runs.filter(F.col(column) == value)
    if tags:
        wanted = F.array(*[F.lit(t) for t in tags])
        runs = runs.filter(F.forall(wanted, lambda t: F.array_contains("tags", t)))
    return runs


def latest(runs: DataFrame, status: str | None = None) -> DataFrame:
    """Newest run per model name."""
    rows = list_models(runs, status=status)
    newest = F.max_by(F.struct(*[c for c in rows.columns if c != "model_name"]), F.struct("created_at", "model_id"))
    return rows.groupBy("model_name").agg(newest.alias("_r")).select("model_name", "_r.*")


def statistics(runs: DataFrame) -> DataFrame:
    """(section, name, value): runs by status (zeros kept) and type, and the total size."""
    by_status = runs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]).unpivot([], STATUSES, "name", "value")
    by_type = runs.groupBy(F.col("model_type").alias("name")).agg(F.count("*").alias("value"))
    whole = runs.agg(F.count("*").alias("total_models"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"))

    def section(df, label):
        return df.select(F.lit(label).alias("section"), "name", F.col("value").cast("bigint").alias("value"))

    return section(by_status, "status").unionByName(section(by_type, "type")).unionByName(
        section(whole.unpivot([], whole.columns, "name", "value"), "total"))


def update_metrics(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge new metric maps (model_id, metrics) into the runs; new values win."""
    fresh = updates.select("model_id", F.col("metrics").alias("_new"))
    merged = F.map_concat(
        F.map_filter("metrics", lambda k, _: ~F.array_contains(F.map_keys("_new"), k)), F.col("_new"))
    return runs.join(fresh, "model_id", "left").withColumn(
        "metrics", F.when(F.col("_new").isNotNull(), merged).otherwise(F.col("metrics"))
    ).select(runs.columns)
