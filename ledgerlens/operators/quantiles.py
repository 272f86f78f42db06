"""Exact order statistics and quantiles that stay bounded at any size.

The wanted ranks are narrowed by repeated histograms: every pass counts rows per bin of the
interval that holds a rank and keeps each bin's true minimum and maximum; it ends when a bin
holds one value. A pass is one scan whose shuffle carries at most (ranks x bins) rows per
map task, and a value held by many rows is one bin, so skew cannot hurt. NaN and the
infinities have bins of their own: they are counted apart and never stretch an interval.
Order: -Infinity, numbers, Infinity, NaN, as Spark sorts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import assign_buckets, range_splits, running_totals

BINS = 2048
INF, NAN = float("inf"), float("nan")


def _finite(x):
    return ~F.isnan(x) & (F.abs(x) < INF)


def extents(df: DataFrame, columns: Sequence[str], by: str | None = None) -> dict:
    """{(group, column): (non-null rows, min, max, -Infinity rows, Infinity rows)} from one bounded
    aggregate; min and max are of the finite values. ``by`` is a class label: one row per class
    goes to the driver."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        ok = F.when(_finite(x), x)
        aggs += [F.count(x).alias(f"n{i}"), F.min(ok).alias(f"lo{i}"), F.max(ok).alias(f"hi{i}"),
                 F.count_if(x == -INF).alias(f"under{i}"), F.count_if(x == INF).alias(f"over{i}"), F.count_if(F.isnan(x)).alias(f"nan{i}")]
    grouped = df.filter(F.col(by).isNotNull()).groupBy(by) if by else df
    out = {}
    for r in grouped.agg(*aggs).collect():
        for i, c in enumerate(columns):
            n, nan = r[f"n{i}"], r[f"nan{i}"]
            out[(r[by] if by else None, c)] = (n, r[f"lo{i}"], r[f"hi{i}"], r[f"under{i}"], r[f"over{i}"] + nan, nan)
    return out


def order_statistics(df: DataFrame, wanted: dict, found: dict, by: str | None = None,
                     bins: int = BINS) -> dict:
    """Values at 0-based ranks. ``wanted``: {(group, column): ranks}; ``found``: ``extents``."""
    result: dict = {}
    open_: list[list] = []  # group, column, lo, hi, rows below lo, ranks
    for (g, c), ranks in wanted.items():
        n, lo, hi, under, over, nan = found.get((g, c), (0, None, None, 0, 0, 0))
        ranks = sorted({r for r in ranks if 0 <= r < n})
        result.update({(g, c, r): -INF for r in ranks if r < under})
        result.update({(g, c, r): INF for r in ranks if n - over <= r < n - nan})
        result.update({(g, c, r): NAN for r in ranks if r >= n - nan})
        ranks = [r for r in ranks if under <= r < n - over]
        if not ranks:
            continue
        if lo == hi:
            result.update({(g, c, r): lo for r in ranks})
        else:
            open_.append([g, c, lo, hi, under, ranks])
    columns = sorted({c for _, c in wanted})
    place = {c: i for i, c in enumerate(columns)}
    group_type = dict(df.dtypes)[by] if by else "int"
    group = F.col(by) if by else F.lit(0)
    # one array of doubles per row, numbered by position: narrower than names in the join
    long = df.select(
        group.alias("group"), F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("place", "value")
    ).filter("value is not null")
    while open_:
        rows = [(i, o[0] if by else 0, place[o[1]], float(o[2]), float(o[3])) for i, o in enumerate(open_)]
        cuts = df.sparkSession.createDataFrame(
            rows, f"interval int, group {group_type}, place int, lo double, hi double"
        )
        inside = long.join(F.broadcast(cuts), ["group", "place"]).filter("value between lo and hi")
        # halves where the width of the interval itself is too large for a double
        part = F.when(F.col("hi") - F.col("lo") < INF, F.lit(1.0)).otherwise(0.5)
        at = F.floor((F.col("value") * part - F.col("lo") * part) / (F.col("hi") * part - F.col("lo") * part) * bins)
        counted = (
            inside.groupBy("interval", F.least(at, F.lit(bins - 1)).alias("bin"))
            .agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
            .collect()
        )
        by_interval: dict[int, list] = {}
        for r in counted:
            by_interval.setdefault(r["interval"], []).append(r)
        nxt = []
        for i, (g, c, old_lo, old_hi, below, ranks) in enumerate(open_):
            left = list(ranks)
            for r in sorted(by_interval.get(i, []), key=lambda b: b["lo"]):
                here = [k for k in left if k < below + r["n"]]
                left = [k for k in left if k >= below + r["n"]]
                if here and r["lo"] == r["hi"]:
                    result.update({(g, c, k): r["lo"] for k in here})
                elif here and (r["lo"], r["hi"]) == (old_lo, old_hi):
                    raise ArithmeticError(f"the interval {old_lo} to {old_hi} of {c} does not shrink")
                elif here:
                    nxt.append([g, c, r["lo"], r["hi"], below, here])
                below += r["n"]
        open_ = nxt
    return result


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict:
    """{(None, column): [linear-interpolated quantile per prob]}; null for empty input.

    Per group: ``quantile_table``.
    """
    found = extents(df, columns)
    wanted = {
        k: {f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)} if n else set()
        for k, (n, *_) in found.items()
    }
    at = order_statistics(df, wanted, found)

    def interpolate(k, n, p):
        if not n:
            return None
        pos = p * (n - 1)
        lo, hi = at[(*k, math.floor(pos))], at[(*k, math.ceil(pos))]
        return lo if lo == hi or pos == math.floor(pos) else lo + (hi - lo) * (pos - math.floor(pos))

    return {k: [interpolate(k, n, p) for p in probs] for k, (n, *_) in found.items()}


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                   by: str | None = None, **kw) -> DataFrame:
    """Long table (group, column, prob, value)."""
    if by:
        return _grouped_table(df, list(columns), [float(p) for p in probs], by, **kw)
    found = quantiles(df, columns, probs, **kw)
    rows = [(c, float(p), v) for (_, c), vs in found.items() for p, v in zip(probs, vs)]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


def _grouped_table(df: DataFrame, columns: list[str], probs: list[float], by: str, buckets: int | None = None) -> DataFrame:
    """Quantiles per group for any number and size of groups, without the driver.

    Equal values are counted and ranked by running totals; the value whose ranks cover a
    wanted position is kept.
    """
    rows = df.filter(F.col(by).isNotNull()).select(by, *[F.col(c).cast("double").alias(c) for c in columns])
    splits = range_splits(rows, columns, buckets)
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), F.col(f"{c}_bucket").alias("bucket")) for c in columns
    ])
    counts = (
        assign_buckets(rows, splits).select(by, F.inline(pairs)).filter("value is not null")
        .groupBy(by, "column", "bucket", "value").agg(F.count("*").alias("n"))
    )
    ranked = running_totals(counts, [by, "column"], "value", {"upto": "n"}, "bucket")
    sizes = counts.groupBy(by, "column").agg(F.sum("n").alias("size"))
    placed = ranked.join(sizes, [by, "column"])

    def covers(rank):
        return (rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto"))

    def at(p):
        return p * (F.col("size") - 1)

    wanted = F.filter(
        F.array(*[F.lit(p) for p in probs]), lambda p: covers(F.floor(at(p))) | covers(F.ceil(at(p)))
    )
    hits = placed.select("*", F.explode(wanted).alias("prob"))
    pos = at(F.col("prob"))
    lo = F.max(F.when(covers(F.floor(pos)), F.col("value")))
    hi = F.max(F.when(covers(F.ceil(pos)), F.col("value")))
    share = F.max(pos - F.floor(pos))
    between = F.when((lo == hi) | (share == 0), lo).otherwise(lo + (hi - lo) * share)
    return hits.groupBy(by, "column", "prob").agg(between.alias("value"))


def ranked_threshold(df: DataFrame, hash_column: str, quota: Callable[[int], Sequence[int]],
                     by: str | None = None) -> dict:
    """Per group: the hash values at the ranks ``quota(rows)`` names (0-based)."""
    found = extents(df, [hash_column], by)
    wanted = {k: set(quota(n)) for k, (n, *_) in found.items()}
    at = order_statistics(df, wanted, found, by)
    return {g: (n, [at.get((g, c, r)) for r in quota(n)]) for (g, c), (n, *_) in found.items()}
