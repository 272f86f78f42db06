"""Exact samples and splits by hash rank.

Rows are ordered by a hash of their key. The hash at the wanted rank is found by
``order_statistics`` (a few bounded aggregates), after which every assignment is a
comparison in a projection: no row is sorted or shuffled, and a label that holds
nearly all rows costs no more than a rare one. The key must identify a row; copies
of a key always land on the same side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .quantiles import ranked_threshold

HASH_DIGITS = 13  # 52 bits: exact in a double


def row_hash(key: list[str], seed: int) -> Column:
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("double")


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def _cases(label: str | None, per_label: dict, pick) -> Column:
    """One expression per label value; other labels (and null) give null."""
    out = None
    for value, found in per_label.items():
        result = pick(found)
        if label is None:
            return result
        hit = F.col(label) == F.lit(value)
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return out if out is not None else F.lit(None)


def _below(h: Column, limit: float | None) -> Column:
    return F.lit(False) if limit is None else h <= F.lit(limit)


def stratified_split(df: DataFrame, label: str, key: list[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: exactly the rounded share of every label."""
    hashed = df.withColumn("_h", row_hash(key, seed))
    found = ranked_threshold(hashed, "_h", lambda n: [half_up(test_share * n) - 1], label)
    test = _cases(label, found, lambda f: _below(F.col("_h"), f[1][0]))
    return hashed.withColumn("is_test", test).drop("_h")


def train_test(df: DataFrame, label: str, key: list[str], test_share: float = 0.2,
               seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows); rows without a label are in neither."""
    marked = stratified_split(df, label, key, test_share, seed)
    return marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")


def stratified_folds(df: DataFrame, label: str, key: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..k-1; within a label the fold sizes differ by at most one."""
    hashed = df.withColumn("_h", row_hash(key, seed))
    found = ranked_threshold(  # reads the hashes several times
        cut_lineage(hashed.select(label, "_h"), "hashes"), "_h", lambda n: [-(-n * i // k) - 1 for i in range(1, k)], label
    )

    def fold(f):
        n, cuts = f
        out = F.lit(0)
        for c in cuts:
            if c is not None:
                out = out + (F.col("_h") > c).cast("int")
            else:
                out = out + F.lit(1)
        return out

    return hashed.withColumn("fold", _cases(label, found, fold)).drop("_h")


def stratified_downsample(df: DataFrame, label: str, key: list[str], above: int | None = None,
                          size: int | None = None, seed: int = 42) -> DataFrame:
    """Of a table with more than ``above`` rows, ``size`` rows with the fraud share kept; both are the caller's, else all rows stay."""
    if above is None or size is None:
        return df
    hashed = df.withColumn("_h", row_hash(key, seed))
    counts = {r[label]: r["n"] for r in df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if total <= above:
        return df
    positive = min(counts.get(1, 0), int(size * counts.get(1, 0) / total))
    quota = {1: positive, 0: min(counts.get(0, 0), size - positive)}
    keep = F.lit(False)
    for value, q in quota.items():
        if q <= 0:
            continue
        part = hashed.filter(F.col(label) == value)
        limit = ranked_threshold(part, "_h", lambda n, q=q: [q - 1])[None][1][0]
        keep = keep | ((F.col(label) == value) & _below(F.col("_h"), limit))
    return hashed.filter(keep).drop("_h")


def uniform_sample(df: DataFrame, key: list[str], size: int, seed: int = 42) -> DataFrame:
    """Exactly ``size`` rows, or all if there are fewer."""
    hashed = df.withColumn("_h", row_hash(key, seed))
    _, (limit,) = ranked_threshold(hashed, "_h", lambda n: [min(size, n) - 1])[None]
    return hashed.filter(F.col("_h") <= limit).drop("_h") if limit is not None else df.limit(0)
