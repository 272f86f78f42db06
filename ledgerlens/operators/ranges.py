"""Rows matched with a table of ranges, without comparing all with all.

A range is put into the cells of a grid whose cells are at least as wide as itself, at most two; a value is looked up in its
cell of every grid in use, and then tested exactly. Grids double in width, so there are as many as ranges differ in size by
powers of two, whatever the number of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value * F.pow(F.lit(2.0), level)).cast("long")


def lowest_match(df: DataFrame, value: str, id: str, ranges: DataFrame, top: float = 1.0) -> DataFrame:
    """``id`` and the smallest ``position`` of the ranges that hold ``value``; rows that no range holds are left out.

    ``ranges`` has ``position``, ``low``, ``high`` for ``low <= value < high``; a range that ends at ``top`` or beyond includes its end. Ranges
    without extent, or with a null or NaN end, hold nothing.
    """
    low, high = F.col("low"), F.col("high")
    sound = (high > low) & ~F.isnan("low") & ~F.isnan("high") & (high < float("inf")) & (low > float("-inf"))
    # equal ranges count once, with their lowest position
    kept = ranges.where(sound).groupBy(low.cast("double").alias("low"), high.cast("double").alias("high")).agg(F.min("position").alias("position"))
    kept = kept.withColumn("_level", F.floor(-F.log2(high - low)).cast("int"))
    cells = F.array_distinct(F.array(_cell(low, F.col("_level")), _cell(high, F.col("_level"))))
    dealt = kept.withColumn("_cell", F.explode(cells))
    levels = sorted(r["_level"] for r in kept.select("_level").distinct().collect())  # a row a grid
    if not levels:
        return df.select(id).limit(0).withColumn("position", F.lit(None).cast(ranges.schema["position"].dataType))
    v = F.col(value).cast("double")
    looked = df.where(v.isNotNull() & ~F.isnan(v)).select(F.col(id), v.alias("_v"), F.explode(F.array(*[F.lit(x) for x in levels])).alias("_level"))
    looked = looked.withColumn("_cell", _cell(F.col("_v"), F.col("_level")))
    inside = (F.col("_v") >= low) & ((F.col("_v") < high) | ((F.col("_v") == high) & (high >= top)))
    return looked.join(dealt, ["_level", "_cell"]).where(inside).groupBy(id).agg(F.min("position").alias("position"))
